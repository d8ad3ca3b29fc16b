"""Secrets, order and length of JSON payloads of any depth.

Built-in functions reach a fixed depth only, so rows pass through Python in Arrow batches, bounded in bytes as payloads can be
long.  Each operator adds a column, in place of one of that name.  Null gives null, and so does what is no JSON: what can't be
read can't be cleared.  Repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DataType, StringType, StructField, StructType

from siltstone.functions import json_text

#: Parts of keys whose values a log hides.
HIDDEN = ("password", "token", "cookie", "secret", "authorization")
#: Keys that a stored response may not have, and marks of secrets in its texts.
FORBIDDEN_KEYS = ("api_key", "api_token", "token", "authorization", "x-finnhub-token")
SECRET_QUERY = ("api_key=", "api_token=", "token=")
#: Where a provider's items are; of the last one, a filing's columns of items.
ITEM_PATHS = {"marketaux": ("data",), "eia": ("response", "data"), "sec_edgar": ("filings", "recent")}
COLUMNAR = ("sec_edgar",)
#: Providers whose body is one item.
WHOLE = ("finnhub",)
#: Payloads that are handed to Python at once.
BATCH_BYTES, BATCH_ROWS = 16_000_000, 1_000


def _hides(path: tuple[str | None, ...], name: str | int, value: str, string: str | None) -> str:
    """What a log may show: the value, unless its key tells of a secret."""
    shown = isinstance(name, int) or not any(mark in name.lower() for mark in HIDDEN)
    return value if shown else '"[REDACTED]"'


def _marked(text: str) -> bool:
    return any(mark in text.lower() for mark in SECRET_QUERY)


def _stores(path: tuple[str | None, ...], name: str | int, value: str, string: str | None) -> str | None:
    """What may be stored: nothing under a forbidden key, and no text that holds a secret."""
    forbidden = isinstance(name, str) and name.lower() in FORBIDDEN_KEYS
    return None if forbidden or (string is not None and _marked(string)) else value


def _cuts(provider: str | None, limit: int) -> json_text.Rule:
    """Stores, and of the provider's items, or of each of its columns of items, only the first ``limit``."""
    path = ITEM_PATHS.get(provider)

    def rule(at: tuple[str | None, ...], name: str | int, value: str, string: str | None) -> str | None:
        listed = path and isinstance(name, int) and (at[:-1] if provider in COLUMNAR else at) == path
        return None if listed and name >= limit else _stores(at, name, value, string)

    return rule


def _has_secret(text: str, _: object) -> bool:
    """Whether there is anything that may not be stored."""
    found = []

    def rule(path: tuple[str | None, ...], name: str | int, value: str, string: str | None) -> str:
        if _stores(path, name, "", string) is None:
            found.append(name)
        return ""  # only what is met counts, not the text

    whole = json_text.rewritten(text, rule)
    return bool(found) or (whole.startswith('"') and _marked(whole))


def _added(df: DataFrame, name: str, kind: DataType, payload: str, made: Callable[[str, object], object], beside: str | None = None) -> DataFrame:
    """``df`` with ``name`` = made(payload, value of the column ``beside``)."""
    kept = [f for f in df.schema.fields if f.name != name]
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key).removesuffix("b")
        if not now.isdigit() or int(now) not in range(1, most + 1):
            conf.set(key, str(most))

    def one(text: str | None, other: object) -> object:
        try:
            return None if text is None else made(text, other)
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(payload).to_pylist()
            others = batch.column(beside).to_pylist() if beside else [None] * len(texts)
            column = pa.array(map(one, texts, others), to_arrow_type(kind))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), column], [*(f.name for f in kept), name])

    return df.mapInArrow(run, StructType([*kept, StructField(name, kind)]))


def redacted(df: DataFrame, payload: str, name: str) -> DataFrame:
    """Adds the JSON text with the values of keys that tell of a secret replaced, at any depth; compact and in ASCII."""
    return _added(df, name, StringType(), payload, lambda text, _: json_text.rewritten(text, _hides))


def cleaned(df: DataFrame, payload: str, name: str) -> DataFrame:
    """Adds the JSON text without forbidden keys, and without entries and elements whose text holds a secret."""
    return _added(df, name, StringType(), payload, lambda text, _: json_text.rewritten(text, _stores))


def with_secret_flag(df: DataFrame, payload: str, name: str) -> DataFrame:
    """Adds whether a forbidden key or a text with a secret stands anywhere in the JSON text."""
    return _added(df, name, BooleanType(), payload, _has_secret)


def shortened(df: DataFrame, payload: str, name: str, limit: int, *, provider: str = "provider") -> DataFrame:
    """Adds ``cleaned`` with the provider's list of items, or each of its columns of items, cut to the first ``limit``."""
    return _added(df, name, StringType(), payload, lambda text, whose: json_text.rewritten(text, _cuts(whose, limit)), provider)


def canonical(df: DataFrame, payload: str, name: str) -> DataFrame:
    """Adds the canonical JSON text: sorted keys, no spaces, ASCII, so that equal values are equal byte for byte."""
    return _added(df, name, StringType(), payload, lambda text, _: json_text.canonical(text))


def item_texts(df: DataFrame, payload: str, name: str, *, provider: str = "provider") -> DataFrame:
    """Adds the provider's items as an array of canonical JSON texts, whole and in order: elements of its list that are
    objects, rows of its columns (as many as the longest has, each with the columns that reach so far), or the payload itself
    if it is the one item.  No items, and an unknown provider's, are an empty array."""

    def items(text: str, whose: object) -> list[str]:
        path = ITEM_PATHS.get(whose)
        found: dict[object, list[str]] = {}

        def rule(at: tuple[str | None, ...], key: str | int, value: str, string: str | None) -> str:
            if path and isinstance(key, int) and (at[:-1] if whose in COLUMNAR else at) == path:
                found.setdefault(at[-1] if whose in COLUMNAR else None, []).append(value)
            return value

        whole = json_text.rewritten(text, rule, ordered=True)
        if whose in WHOLE:
            return [whole] if whole.startswith("{") and whole != "{}" else []
        if whose in COLUMNAR:
            longest = max(map(len, found.values()), default=0)
            return ["{" + ",".join(f"{json.dumps(k)}:{v[i]}" for k, v in sorted(found.items()) if i < len(v)) + "}" for i in range(longest)]
        return [v for v in found.get(None, []) if v.startswith("{")]

    return _added(df, name, ArrayType(StringType()), payload, items, provider)
