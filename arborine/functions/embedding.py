"""Feature hashing of texts into unit vectors, exact and in pure SQL form, and distances."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 384


def null_embedder(dim: int = DIM) -> Callable[[Column], Column]:
    """An embedder to zeros."""
    return lambda text: F.array_repeat(F.lit(0.0), dim)


#: Tokens of a text and words of a token (fixed values).
_TOKEN = re.compile("[A-Za-z0-9]+")
_PART = re.compile("[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def token_features(token: str) -> list[str]:
    """Features of one token, as ``text_features`` has them for a text."""
    out = []
    for word in dict.fromkeys([token.lower(), *map(str.lower, _PART.findall(token))]):
        edged = f"#{word}#"
        out += [f"w:{word}", *(f"3:{edged[i : i + 3]}" for i in range(len(word)))]
    return out


def hashing_embedder(dim: int = DIM):
    """A Pandas UDF from texts to unit vectors by 8-byte blake2b; a null text or one without tokens gives zeros."""
    known: dict[str, np.ndarray] = {}

    def token_vector(token: str) -> np.ndarray:
        got = known.get(token)
        if got is None:
            got = np.zeros(dim)
            for feature in token_features(token):
                value = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")
                got[value % dim] += 1.0 if value >> 63 else -1.0
            if np.abs(got).max(initial=0) < 128:  # an eighth of the memory, the same sums
                got = got.astype(np.int8)
            if len(known) > 20_000:
                known.clear()
            known[token] = got
        return got

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            v = np.zeros(dim)
            for token in _TOKEN.findall(text or ""):
                v += token_vector(token)
            n = np.sqrt((v * v).sum())
            out.append(v / n if n else v)
        return pd.Series(out)

    return embed


def native_places(feature: Column, dim: int) -> tuple[Column, Column]:
    """Bucket and sign of a feature from its md5, for use inside SQL."""
    value = F.conv(F.substring(F.md5(feature), 1, 15), 16, 10).cast("long")
    return F.pmod(value, F.lit(dim)).cast("long"), F.when(F.substring(F.md5(feature), 16, 1).isin(*"01234567"), 1.0).otherwise(-1.0)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def score(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)
