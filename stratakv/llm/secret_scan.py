"""Secrets in text, by one deterministic automaton over all rules.

All rules are compiled into one minimal deterministic automaton that reads a text
once, from its last byte to its first: after each byte its state tells the rules
of which a match begins there.  (A text with such a place, which few have, is
read so again to note the places.)  The matches themselves are then followed from
their starts, so no byte is tried from a start that leads nowhere, and the time
is linear in the text.  Rules are given as expressions (see ``automaton``), with
the least length of the part that holds the secret; a match that is too short is
dropped without another try.

Cases: a null or empty text has no spans; a very long text is read whole; ties of start are ordered by rule;
nulls in other columns and other columns pass through; an empty table gives
none; repeated rows are scanned each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import char_starts, slices, text_buffer
from ._store import table
from .automaton import Automaton


@dataclass(frozen=True)
class Rule:
    """expression = lead + body; a match counts if its body has at least ``least`` bytes.

    from_run: the body's runs that are shorter cannot hide a longer match, so the combined automaton asks for ``least`` bytes itself.
    """

    kind: str
    lead: str
    body: str
    least: int
    from_run: bool = False

    @property
    def sought(self) -> str:
        return self.body.removesuffix("+") + f"{{{self.least}}}" if self.from_run else self.lead + self.body


#: The rules of the base, in the order of their kinds; values fixed by the contract.
BASE = (
    Rule("assign", "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", "", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "", "[0-9a-f]+", 24, True),
)

#: Further well-known forms of credentials.
ADDED = (
    Rule("github", "", "gh[opsru]_[A-Za-z0-9]+", 40),
    Rule("slack", "", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", "", "AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", "", "[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("jwt", "", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 40),
    Rule("private_key", "", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 1),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.combined = Automaton([r.sought for r in rules], anywhere=True, backward=True)
        self.whole = [Automaton([r.lead + r.body]) for r in rules]
        self.lead = [Automaton([r.lead]) if r.lead else None for r in rules]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, in order: leftmost, longest, non-overlapping matches of each rule."""
        if not self.combined.seen(data):
            return []
        out, free = [], [0] * len(self.rules)
        for a, bits in reversed(self.combined.starts(data)):
            while bits:
                k = (bits & -bits).bit_length() - 1
                bits &= bits - 1
                if a < free[k]:
                    continue
                free[k] = b = self.whole[k].longest(data, a)
                body = self.lead[k].longest(data, a) if self.lead[k] else a
                if b - body >= self.rules[k].least:
                    out.append((a, k, b))
        return out


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


SPANS = "array<struct<kind:string,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, text: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` with the spans of its secrets, in code points, as a further column (which replaces one of that name)."""
    rest = docs.drop(into)
    schema = rest.select("*", F.lit(None).cast(SPANS).alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = scanner(rules)
        for batch in batches:
            for part in slices(batch, text):
                data, at = text_buffer(part.column(part.schema.get_field_index(text)))
                raw, rows = data.tobytes(), []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = raw[a:b]
                    spans = found.spans(own)
                    if spans:
                        place = char_starts(np.frombuffer(own, np.uint8))
                        spans = [{"kind": rules[k].kind, "start": int(place[s]), "end": int(place[e])} for s, k, e in spans]
                    rows.append(spans)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, _ARROW)], names=[*part.schema.names, into])

    return rest.mapInArrow(run, schema)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED, mark: str = "<SECRET>") -> DataFrame:
    """``docs`` with each stretch of secret text replaced by ``mark``; its columns stay as they were."""
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = scanner(rules)
        for batch in batches:
            for part in slices(batch, "text"):
                k = part.schema.get_field_index("text")
                texts = []
                for value in part.column(k).to_pylist():
                    data = (value or "").encode()
                    spans = found.spans(data)
                    if spans:
                        pieces, done = [], 0
                        for a, _, b in spans:
                            if a >= done:
                                pieces += [data[done:a], mark.encode()]
                            done = max(done, b)
                        value = b"".join([*pieces, data[done:]]).decode()
                    texts.append(value)
                yield part.set_column(k, part.schema.field(k), pa.array(texts, part.schema.field(k).type))

    out = docs.mapInArrow(run, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast(schema["n_chars"].dataType)))
    return out


def joined(spans: str) -> str:
    """SQL: kind:start:end of each span, comma-joined."""
    return f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"


def op3_combined_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kinds = ", ".join(f"'{r.kind}'" for r in BASE)
    found = scan(docs).select("doc_id", "secrets", F.expr(f"filter(secrets, x -> x.kind in ({kinds}))").alias("base"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{r.kind}')) as bigint)").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.expr(f"sha2(cast({joined('base')} as binary), 256)").alias("base_sha256"), F.expr(joined("secrets")).alias("spans"))
