"""Reply cleaning and judge-score parsing on literal edge rows (FIXTURES §3)."""

import json

from supportflow.functions.parsing import clean_replies, last_score, parse_judge_six

SIX = ["correctness", "groundedness", "helpfulness", "brand_consistency", "safety", "overall"]


def _run_replies(spark, raws):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "id int, raw string")
    out = clean_replies(df, "raw", brand="AppleSupport").orderBy("id").collect()
    return [(r["reply"], r["reject_reason"]) for r in out]


def test_clean_replies_edge_rows(spark):
    raws = [
        '{"reply": "Please try restarting your device."}',     # good JSON
        '{"answer": "no reply key here"}',                      # JSON without reply
        '[{"reply": "Hello there friend"}]',                    # JSON list -> embedded object
        '{"reply": "Thanks for reaching out today."} extra',    # JSON then trailing text
        '<think>hmm</think>Reply: Please update to the latest version.',
        "Reply: Assistant: Hello, how can we help?",            # stacked prefixes in list order
        "Response: Response: Response: Hello there",            # each pass strips a prefix once
        "We need to answer the customer politely.",             # bad start
        "Sure thing. Customer message: blah blah blah",         # marker
        "123456789",                                            # 9 chars
        "1234567890",                                           # 10 chars
        "x" * 1000,
        "x" * 1001,
        "",
        None,
        '{"reply": ""}',
        "   {not json at all}   ",
        "Response:   ",
    ]
    got = _run_replies(spark, raws)
    assert got[0] == ("Please try restarting your device.", None)
    assert got[1] == (None, "json_without_reply")
    assert got[2] == ("Hello there friend", None)
    assert got[3] == ("Thanks for reaching out today.", None)
    assert got[4] == ("Please update to the latest version.", None)
    assert got[5] == ("Hello, how can we help?", None)
    assert got[6] == ("Response: Hello there", None)
    assert got[7] == (None, "reasoning_start")
    assert got[8] == (None, "reasoning_marker")
    assert got[9] == (None, "too_short")
    assert got[10] == ("1234567890", None)
    assert got[11] == ("x" * 1000, None)
    assert got[12] == (None, "too_long")
    assert got[13] == (None, "empty")
    assert got[14] == (None, "empty")
    assert got[15] == (None, "json_without_reply")
    assert got[16] == (None, "structured")
    assert got[17] == (None, "too_short")


def _six(spark, raws):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "id int, raw string")
    out = parse_judge_six(df, "raw").orderBy("id").collect()
    return [(tuple(r[m] for m in SIX), r["method"]) for r in out]


def test_judge_six_cascade(spark):
    js = json.dumps(dict(zip(SIX, [4, 4, 3, 4, 5, 4])))
    raws = [
        js,
        json.dumps({m: "4/5" for m in SIX}),
        "Correctness: 4\nGroundedness: 3\nHelpfulness: 4\nBrand consistency: 5\nSafety: 5\nOverall: 4",
        "4 4 3 4 5 4",
        "4, 4, 3, 4, 5, 4",
        "4|4|3|4|5|4",
        json.dumps(dict(zip(SIX, [6, 4, 3, 4, 5, 4]))),     # score 6 -> not valid anywhere
        json.dumps(dict(zip(SIX[:5], [4, 4, 3, 4, 5]))),     # missing metric
        "",
        None,
        "<think>reasoning 1 2 3</think>" + js,
        "Scores follow. " + js + " and then {not json}",      # candidate from the end
        "overall=2 safety - 3 brand:4 helpfulness:5 groundedness:1 CORRECTNESS: 2",
    ]
    got = _six(spark, raws)
    assert got[0] == ((4, 4, 3, 4, 5, 4), "json")
    assert got[1] == ((4, 4, 4, 4, 4, 4), "json")
    assert got[2] == ((4, 3, 4, 5, 5, 4), "labelled")
    assert got[3] == ((4, 4, 3, 4, 5, 4), "sequence")
    assert got[4] == ((4, 4, 3, 4, 5, 4), "sequence")
    assert got[5] == ((4, 4, 3, 4, 5, 4), "sequence")
    assert got[6] == ((0,) * 6, None)
    assert got[7] == ((0,) * 6, None)
    assert got[8] == ((0,) * 6, None)
    assert got[9] == ((0,) * 6, None)
    assert got[10] == ((4, 4, 3, 4, 5, 4), "json")
    assert got[11] == ((4, 4, 3, 4, 5, 4), "json")
    assert got[12] == ((2, 1, 5, 4, 3, 2), "labelled")


def test_last_score(spark):
    raws = ["4", "I give it 4/5", "<think>3</think> Score: 2", "no digits", "<think>only open 4",
            "12 and 45", "", None, "3 then 123"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "id int, raw string")
    got = [r["s"] for r in df.select("id", last_score("raw").alias("s")).orderBy("id").collect()]
    assert got == [4, 5, 2, None, 4, None, None, None, 3]


def test_repeated_json_key_keeps_the_last_value(spark):
    assert _run_replies(spark, ['{"reply": "the first reply text", "reply": "the second reply text"}']) == [
        ("the second reply text", None)]
    js = "{" + ", ".join(f'"{m}": 1, "{m}": {i % 5 + 1}' for i, m in enumerate(SIX)) + "}"
    df = spark.createDataFrame([(1, js)], "id int, raw string")
    r = parse_judge_six(df, "raw").first()
    assert [r[m] for m in SIX] == [1, 2, 3, 4, 5, 1] and r.method == "json"
