"""Functions over arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import text as X


def quality_flags(c: Column) -> Column:
    """ARR1 without duplicates: flags in fixed order, over the whole text but for math, which is looked for in the body."""
    flags = (
        (F.length(c) < 300, "too_short"),
        (F.length(c) > 15000, "too_long"),
        (~X.has_math(c), "no_math_detected"),
        (X.odd_dollars(c), "unbalanced_dollars"),
        (X.count_of(c, r"\begin{") != X.count_of(c, r"\end{"), "unbalanced_environments"),
        (X.has_illegible(c), "contains_illegible_marker"),
        (F.contains(F.lower(c), F.lit("<think>")), "contains_think_block"),
    )
    return F.array_compact(F.array(*(F.when(test, name) for test, name in flags)))


def passes(flags: Column) -> Column:
    """ARR2: nothing but an illegible marker is flagged."""
    return F.size(F.array_remove(flags, "contains_illegible_marker")) == 0


def conversation(image_prompt: str, answer: Column) -> Column:
    """ARR3: a user's and an assistant's message."""
    return F.array(F.struct(F.lit("user").alias("role"), F.lit(image_prompt).alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content")))


def finite(c: Column, kind: T.DataType) -> Column:
    """ARR4: NaN and infinities become null, at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: finite(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(finite(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return c


def finite_columns(df: DataFrame) -> DataFrame:
    return df.select(*(finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def key_list(c: Column, limit: int | None = None) -> Column:
    """ARR5: the trimmed, non-empty parts between commas, the first limit of them."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(parts, 1, limit) if limit else parts


def state_hash(*columns: str) -> Column:
    """ARR8: changes when one of the columns does; null differs from empty."""
    return F.substring(F.md5(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})), 1, 12)


def fit_length(ids: Column, length: int, pad: int) -> Column:
    """ARR11: cut to a length, else padded."""
    return F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def labels(prompt: Column, target: Column, length: int, eos: int) -> Column:
    """ARR11: -100 for the prompt and what pads, the target's ids between; the target is cut so that its end fits."""
    room = F.greatest(F.lit(length) - F.size(prompt) - 1, F.lit(0))
    body = F.concat(F.slice(target, F.lit(1), room), F.array(F.lit(eos)))
    return fit_length(F.concat(F.array_repeat(F.lit(-100), F.size(prompt)), body), length, -100)


def loss_start(ids: Column, assistant: int, newline: int, prompt: Column) -> Column:
    """ARR12: behind the last assistant token and a newline after it; the prompt's length where there is none."""
    back = F.array_position(F.reverse(ids), F.lit(assistant))
    at = (F.size(ids) - back + 1).cast("int")
    return F.when(back == 0, prompt).otherwise(at + F.when(F.try_element_at(ids, at + 1) == newline, 1).otherwise(0))


def masked(ids: Column, start: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(-100), start), F.slice(ids, start + 1, F.greatest(F.size(ids) - start, F.lit(0))))


def with_images(messages: Column, fit) -> Column:
    """IMG9: each message's images through fit."""
    return F.transform(messages, lambda m: m.withField("images", F.transform(m["images"], fit)))


def fit_payload(payload: DataFrame, fit, images: str = "images", messages: str = "messages") -> DataFrame:
    """IMG9: a payload's images at the top, in its messages, or both, through fit; a shape that it lacks stays away, nulls stay null."""
    out = {}
    if images in payload.columns:
        out[images] = F.transform(images, fit)
    if messages in payload.columns and "images" in payload.schema[messages].dataType.elementType.names:
        out[messages] = with_images(F.col(messages), fit)
    return payload.withColumns(out)


def whole_labels(ids: Column, prompt: Column, length: int) -> Column:
    """ARR11, the other way to truncate: the ids as one sequence, -100 for the prompt, cut at the end and not padded."""
    return F.slice(masked(ids, F.least(prompt, F.size(ids))), 1, length)


def padded_batch(df: DataFrame, batch: str, *columns: tuple[str, int]) -> DataFrame:
    """ARR11: arrays filled up to the longest of their batch, each with its own value."""
    most = df.groupBy(batch).agg(F.max(F.greatest(*(F.size(c) for c, _ in columns), F.lit(0))).alias("_most"))
    filled = {c: F.concat(F.col(c), F.array_repeat(F.lit(v), F.col("_most") - F.size(c))) for c, v in columns}
    return df.join(most, batch).withColumns(filled).drop("_most")


def without_heavy(df: DataFrame, *fields: str) -> DataFrame:
    """ARR7: a read model without its heavy fields; a scan of it doesn't read them."""
    return df.drop(*fields)


def choose_models(keys: list[str], legacy: tuple[str | None, str | None] = (None, None)) -> list[str]:
    """ARR9: distinct keys, those of old parameters where none are given; two at least."""
    found = list(dict.fromkeys(k for k in (keys or legacy) if k))
    if len(found) < 2:
        raise ValueError("two different models are needed")
    return found
