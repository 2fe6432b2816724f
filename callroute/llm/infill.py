"""Fill-in-the-middle texts by rotating blocks in place.

A text is cut into prefix, middle and suffix at token ends. Sentinels go into
a buffer of its bytes where the parts begin, and one exchange of neighbouring
blocks brings them into order:

* psm: ``<P>prefix`` stays, ``<M>middle`` and ``<S>suffix`` change places;
* spm: ``<P>prefix<M>middle`` and ``<S>suffix`` change places.

Blocks are exchanged by three reversals: of each block, then of both. The
inverse finds the sentinels, exchanges the blocks back and takes them out, so
output and form alone give the exact text again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
RATE, SPM = 50, 80  # of 100 texts that many are rotated, of 100 rotated ones that many to spm
_SWAP = 1 << 16  # bytes that a reversal exchanges at a time
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def reverse(view: np.ndarray, start: int, end: int) -> None:
    """Turn ``view[start:end]`` round in place, outer blocks first."""
    while end - start > 1:
        n = min(_SWAP, (end - start) // 2)
        head = view[start : start + n].copy()
        view[start : start + n] = view[end - n : end][::-1]
        view[end - n : end] = head[::-1]
        start, end = start + n, end - n


def exchange(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """``buffer[start:cut]`` and ``buffer[cut:end]`` change places, in place."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view, start, cut)
    reverse(view, cut, end)
    reverse(view, start, end)


def token_ends(data: bytes) -> np.ndarray:
    """Where tokens end: a word with the white space before it is one, white space at the end another."""
    space = _SPACE[np.frombuffer(data, np.uint8)]
    last = ~space
    last[:-1] &= space[1:]
    ends = np.flatnonzero(last) + 1
    return np.append(ends, len(data)) if len(data) and space[-1] else ends


def draws(key: str) -> list[int]:
    """Four numbers below 2**32 that only depend on the key."""
    digits = hashlib.sha256(key.encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]


def rotate(data: bytes, h: list[int], rate: int = RATE, spm: int = SPM) -> tuple[bytes | bytearray, str, int, int | None, int | None]:
    """(output, form, number of tokens, end of the prefix, end of the middle); no ends if plain."""
    ends = token_ends(data)
    n = len(ends)
    if not data or h[2] % 100 >= rate or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)):
        return data, "plain", n, None, None
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (int(ends[x - 1]) if x else 0 for x in (first, second))
    buffer = bytearray(data)
    for at, mark in ((b, SUFFIX), (a, MIDDLE), (0, PREFIX)):  # from the back: no cut moves
        buffer[at:at] = mark
    middle, suffix = a + len(PREFIX), b + len(PREFIX) + len(MIDDLE)
    form = "spm" if h[3] % 100 < spm else "psm"
    exchange(buffer, 0 if form == "spm" else middle, suffix, len(buffer))
    return buffer, form, n, a, b


def restore(data: bytes, form: str) -> bytes | bytearray:
    """The text that ``rotate`` made this output of."""
    if form == "plain":
        return data
    buffer = bytearray(data)
    start = 0 if form == "spm" else buffer.index(SUFFIX)
    exchange(buffer, start, buffer.index(PREFIX if form == "spm" else MIDDLE), len(buffer))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(mark)
        del buffer[at : at + len(mark)]
    return buffer


def _characters(data: bytes) -> int:
    return len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))


def _texts(values: list) -> pa.Array:
    return pa.array([bytes(v) for v in values], pa.binary()).cast(pa.string())


def _column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return common.texts_of(batch, name).cast(pa.binary()).to_pylist()


def _rotating(keep: list[str], rate: int, spm: int):
    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "_infill_text"):
                keys = part.column("_infill_key").to_pylist()
                rows = []
                for data, key in zip(_column(part, "_infill_text"), keys, strict=True):
                    out, form, n, a, b = rotate(data, draws(key), rate, spm)
                    sizes = (None, None) if a is None else (_characters(data[:a]), _characters(data[a:b]))
                    rows.append((out, form, n, *sizes))
                out, form, n, before, middle = zip(*rows, strict=True)
                columns = [_texts(out), pa.array(form), *(pa.array(x, pa.int64()) for x in (n, before, middle))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + columns, [*keep, "_output", "_form", "_units", "_prefix_chars", "_middle_chars"])

    return run


def _restoring(keep: list[str]):
    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "_output"):
                texts = [restore(x, form) for x, form in zip(_column(part, "_output"), part.column("_form").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [_texts(texts)], [*keep, "_restored"])

    return run


def key(doc_id: str | Column, seed: int) -> Column:
    """What a document's draws come from: seed and id; a null id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))


def _fields(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def _refuse(columns: list[str], taken: set[str]) -> None:
    if clash := taken & set(columns):
        raise ValueError(f"columns that the operator adds are there already: {sorted(clash)}")


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 42, rate: int = RATE, spm: int = SPM, keep: list[str] | None = None) -> DataFrame:
    """One row per row: the columns ``keep`` (all, if not named), then ``_output`` (the text with its parts
    rotated, or as it is), ``_form`` (plain, psm, spm), ``_units`` (tokens), ``_prefix_chars`` and
    ``_middle_chars`` (code points, null if plain).

    A null text counts as empty; an empty text, and one that holds a sentinel,
    stays plain. A text without white space is one token. Cuts depend on seed
    and id alone: repeated rows give equal rows, rows of one id are cut by the
    same draws. Very long texts are rotated in one buffer. An empty table gives
    an empty table. A kept column named like one of the added ones is refused.
    """
    common.ship(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    _refuse(keep, {"_output", "_form", "_units", "_prefix_chars", "_middle_chars", "_infill_text", "_infill_key"})
    kept = docs.select(*keep)
    rows = docs.select(*keep, F.col(text).cast("string").alias("_infill_text"), key(doc_id, seed).alias("_infill_key"))
    return rows.mapInArrow(_rotating(keep, rate, spm), f"{_fields(kept)}_output string, _form string, _units long, _prefix_chars long, _middle_chars long")


def restored(rotated: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with ``_restored``, the exact text rebuilt from ``_output`` and ``_form`` alone."""
    common.ship(rotated.sparkSession)
    _refuse(rotated.columns, {"_restored"})
    return rotated.mapInArrow(_restoring(rotated.columns), f"{_fields(rotated)}_restored string")


def oracle_sql(seed: int = 42, rate: int = RATE, spm: int = SPM) -> str:
    """The registered query in DuckDB SQL."""
    space = r"\x20\x09-\x0D"
    return rf"""
with d as (select doc_id, coalesce(text, '') as t, sha256('{seed}:' || coalesce(doc_id::varchar, '')) as h,
  regexp_extract_all(coalesce(text, ''), '[{space}]*[^{space}]+|[{space}]+') as u from documents),
e as (select *, len(u)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
f as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= {rate} then 'plain' when h4 % 100 < {spm} then 'spm' else 'psm' end as form from e),
g as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from f)
select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256 from g
"""
