"""Quality rules as a ledger: every rule is evaluated once, its bit and the measurements are kept.

``ledger`` measures each whole text in one scan without a shuffle and sets bit i of ``fail_bits`` where
rule i fails. ``stored`` writes ids, measurements and bits, without the texts. Policies are versioned masks over these
bits: ``apply_policy`` and ``ablation`` read the ledger only, so a new policy costs no pass over the texts.

Null or empty text: all measurements 0, so the word minimum fails. Null and repeated ids and repeated rows each have
their entry; an empty table has none. Extra columns pass through; those named like a measurement, ``fail_bits`` or
``kept`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.kit import U64, Words, covered, cut_lineage, mix, portions, utf8, windows, within

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


def measure(texts: list[bytes | None], window: int = 8) -> dict[str, np.ndarray]:
    """The measurements of each text; n_repeat_words over windows of so many words."""
    out = {m: np.zeros(len(texts), np.int64) for m in MEASURES}
    for at, part in portions(texts):
        w = Words(part)
        s = slice(at, at + len(part))

        def per_text(flags, w=w):
            total = np.concatenate(([0], np.cumsum(flags)))
            return total[w.base[1:] - 1] - total[w.base[:-1]]

        out["n_words"][s] = w.count
        out["word_chars"][s] = per_text(~w.gap & ((w.buf & 0xC0) != 0x80))
        out["n_symbols"][s] = per_text(_SYMBOL[w.buf])
        out["n_upper"][s] = per_text(_UPPER[w.buf])
        out["n_letters"][s] = per_text(_LETTER[w.buf])
        for i, t in enumerate(part):
            seen: set[bytes] = set()
            for line in t.split(b"\n"):
                if line in seen:
                    out["n_dup_lines"][at + i] += bool(line.strip())
                else:
                    seen.add(line)
        g, ok = windows(w.hashes(), window), within(w.doc, window)
        if ok.any():
            where = np.flatnonzero(ok)
            g = g[where] ^ mix(w.doc[where].astype(U64) + U64(1))  # alike only within one text
            order = np.argsort(g, kind="stable")
            same = g[order][1:] == g[order][:-1]
            twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
            hit = covered(where[order[twice]], window, len(w.start))
            out["n_repeat_words"][s] = np.bincount(w.doc[hit], minlength=len(part))
    return out


def rules() -> list[tuple[str, Column]]:
    """(name, fails) of each rule over the measurements; the position is the bit. Only append to it."""
    n, c = F.col("n_words"), F.col
    return [
        ("few_words", n < 20),
        ("repeated_windows", 100 * c("n_repeat_words") > 30 * n),
        ("symbols", 10 * c("n_symbols") > 3 * n),
        ("duplicate_lines", c("n_dup_lines") >= 5),
        ("short_words", c("word_chars") < 2 * n),
        ("long_words", c("word_chars") > 20 * n),
        ("capitals", (c("n_letters") >= 20) & (2 * c("n_upper") > c("n_letters"))),
    ]


#: Versioned policies: the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "short_words", "long_words", "capitals"),
}


def mask(policy: str | tuple[str, ...]) -> int:
    names = [name for name, _ in rules()]
    return sum(1 << names.index(x) for x in (POLICIES[policy] if isinstance(policy, str) else policy))


def ledger(docs: DataFrame, text: str = "text", window: int = 8) -> DataFrame:
    """docs with the measurements (long) and fail_bits (long)."""
    fields = [f for f in docs.schema.fields if f.name not in (*MEASURES, "fail_bits")]
    schema = T.StructType(fields + [T.StructField(m, T.LongType()) for m in MEASURES])
    at = [f.name for f in fields].index(text)

    def scan(batches):
        for b in batches:
            found = measure(utf8(b.column(at)), window)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(found[m], pa.int64()) for m in MEASURES)], names=schema.names)

    measured = docs.select(*(F.col(f"`{f.name}`") for f in fields)).mapInArrow(scan, schema)
    bits = sum((F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, fails) in enumerate(rules())), F.lit(0).cast("long"))
    return measured.withColumn("fail_bits", bits)


def stored(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ledger itself: keys, measurements and bits, written in the shared folder, from where policies and ablations read it."""
    return cut_lineage(rows.select(*keys, *MEASURES, "fail_bits"))


def apply_policy(rows: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """The ledger's rows with kept (boolean)."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(rows: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """(rule, failed, only_this, kept_without) under a policy, from one count per distinct bit pattern."""
    m = mask(policy)
    counts = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    names = [(i, name) for i, (name, _) in enumerate(rules()) if m >> i & 1]
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, name in names))).alias("r")
    total = counts.select("bits", "n", each).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    return total.groupBy("rule").agg(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("failed"), F.coalesce(F.sum(F.when(alone, F.col("n"))), F.lit(0)).alias("only_this"), F.coalesce(F.sum(F.when(alone | (F.col("bits") == 0), F.col("n"))), F.lit(0)).alias("kept_without"))
