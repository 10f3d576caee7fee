"""Token counts of a document's sections (lines, or fields) from one encoding of the whole document.

The document is encoded once; each token's span joins the sections that it meets. A token that crosses a
boundary is allocated by a rule: to the section that holds its first byte ("first", the default), its last byte
("last"), or the most of its bytes ("most"; ties to the earlier section).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import hashing
from tessera.llm.bpe import codec, text_runs
from tessera.llm.session import ship, spread, tidy

RULES = ("first", "last", "most")


def line_sections(data: np.ndarray) -> np.ndarray:
    """Byte offsets where the lines of a text start; a line keeps its line feed."""
    starts = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    return starts[starts < max(1, len(data))]


def allocate(ends: np.ndarray, starts: np.ndarray, rule: str = "first") -> np.ndarray:
    """The section of each token, for tokens that end at `ends` and sections that start at `starts`."""
    begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    head = np.searchsorted(starts, begin, side="right") - 1
    if rule == "first":
        return head
    tail = np.searchsorted(starts, ends - 1, side="right") - 1
    if rule == "last":
        return tail
    out = head.copy()
    for t in np.flatnonzero(tail > head):
        cuts = np.concatenate([[begin[t]], starts[head[t] + 1 : tail[t] + 1], [ends[t]]])
        out[t] = head[t] + int(np.diff(cuts).argmax())
    return out


def section_counts(docs: DataFrame, vocabulary: str, rule: str = "first", id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, section, first_byte, end_byte, n_tokens, n_crossing): one row for each line of each whole text; its
    tokens by `rule`, and how many of them reach beyond it. Counts of a text's lines add up to its tokens.

    A null or empty text has one empty section without tokens. Rows with a null id come through; repeated rows
    are counted each; extra columns take no part. One map over the scan."""
    _checked(rule)
    return _counted(docs.select(F.col(id_), F.col(text).cast("string").alias("__text")), vocabulary, rule, id_, None)


def field_counts(docs: DataFrame, vocabulary: str, fields: list[str], rule: str = "first", id_: str = "doc_id", between: str = "\n") -> DataFrame:
    """The same for the columns `fields`, joined by `between` (which belongs to the field before it) and encoded once:
    section k is field k. A null field is empty; an empty one has no tokens, as a span without bytes holds none."""
    _checked(rule)
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    parts = [F.concat(p, F.lit(between)) for p in parts[:-1]] + parts[-1:]
    return _counted(docs.select(F.col(id_), F.concat(*parts).alias("__text"), F.array(*map(F.octet_length, parts)).alias("__sizes")), vocabulary, rule, id_, len(fields))


def _checked(rule: str) -> None:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")


def _counted(rows: DataFrame, vocabulary: str, rule: str, id_: str, n_fields: int | None) -> DataFrame:
    ship(rows.sparkSession)
    part = spread(rows)
    names = [id_, "section", "first_byte", "end_byte", "n_tokens", "n_crossing"]
    schema = f"`{id_}` {part.schema[0].dataType.simpleString()}, section int, first_byte int, end_byte int, n_tokens long, n_crossing long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for batch in batches:
            data, offsets = hashing.buffers(batch.column(1))
            if n_fields:
                sizes = np.asarray(batch.column(2).flatten()).astype(np.int64).reshape(-1, n_fields)
                begins = np.cumsum(sizes, axis=1) - sizes
            for a, texts in text_runs(batch.column(1)):
                rows, sections, firsts, lasts, counts, crossing = [], [], [], [], [], []
                for k, packed in enumerate(bpe.encode(texts)):
                    body = data[offsets[a + k] : offsets[a + k + 1]]
                    starts = begins[a + k] if n_fields else line_sections(body)
                    stops = np.append(starts[1:], len(body))
                    ends = bpe.ends(np.frombuffer(packed, "<u4"))
                    where = allocate(ends, starts, rule)
                    begin = ends - bpe.lengths[np.frombuffer(packed, "<u4")]
                    over = (begin < starts[where]) | (ends > stops[where])
                    rows.append(np.full(len(starts), a + k))
                    sections.append(np.arange(len(starts)))
                    firsts.append(starts)
                    lasts.append(stops)
                    counts.append(np.bincount(where, minlength=len(starts)))
                    crossing.append(np.bincount(where[over], minlength=len(starts)))
                out = [batch.column(0).take(pa.array(np.concatenate(rows)))]
                out += [pa.array(np.concatenate(x).astype(kind)) for x, kind in ((sections, np.int32), (firsts, np.int32), (lasts, np.int32), (counts, np.int64), (crossing, np.int64))]
                yield pa.RecordBatch.from_arrays(out, names)

    return part.mapInArrow(tidy(run), schema)
