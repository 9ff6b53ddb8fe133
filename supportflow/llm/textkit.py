"""The library's tokenising and hashing of whole batches, under the name the operators use."""

from supportflow.functions.textkit import *  # noqa: F401,F403
