"""SQL functions of the engine."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from inkwell.functions.snippet import Keyword, Snippets
from inkwell.functions.text import normalize
from inkwell.operators.tokenize import TOKENS, Tokenizer
from inkwell.sources.store import prepare


def register(spark: SparkSession) -> None:
    """normalize_text(text), tokenize(text, kind), snippet(text, keyword, width, max_results, open, close)."""
    prepare(spark)

    @F.pandas_udf("string")
    def normalize_text(s: pd.Series) -> pd.Series:
        return s.map(normalize, na_action="ignore")

    @F.pandas_udf(TOKENS)
    def tokenize(s: pd.Series, kind: pd.Series) -> pd.Series:
        made = {k: Tokenizer(k, normalize=k == "ngram") for k in kind.dropna().unique()}
        return pd.Series([[{"term": t, "pos": p} for t, p in made[k].tokens(x)] if isinstance(x, str) and k in made else None for x, k in zip(s, kind)])

    @F.pandas_udf("array<string>")
    def snippet(s: pd.Series, keyword: pd.Series, width: pd.Series, most: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        made: dict[tuple, Snippets] = {}
        out = []
        for x, *how in zip(s, keyword, width, most, before, after):
            k = tuple(how)
            if k not in made:
                made[k] = Snippets([Keyword(k[0], k[3], k[4])], int(k[1]), int(k[2]))
            out.append(made[k](x) if isinstance(x, str) else None)
        return pd.Series(out)

    for name, f in (("normalize_text", normalize_text), ("tokenize", tokenize), ("snippet", snippet)):
        spark.udf.register(name, f)
