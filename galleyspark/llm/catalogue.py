"""Imports every operator module so that its query is registered."""

from galleyspark.llm import (  # noqa: F401
    exact_dups,
    importance,
    licenses,
    near_dups,
    pfair,
    tiling,
    token_planes,
    pseudonyms,
    secrets,
    spelling,
    topk,
    toxicity,
    vector_codes,
)
from galleyspark.llm.base import CHECKS, JOBS  # noqa: F401
