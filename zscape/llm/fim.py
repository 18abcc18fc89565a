"""Fill-in-the-middle: texts cut in prefix, middle and suffix, put in another order, and restored.

A unit is a word with the white space before it (``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+``), or white space
at the end of the text; n is their number. Hashes of the id pick the two cuts and the form. ``psm`` gives
``<P>prefix<S>suffix<M>middle``, ``spm`` gives ``<S>suffix<P>prefix<M>middle``, ``plain`` the text itself;
empty texts and those that hold one of the marks are plain.

Assembly is a secondary sort. A text becomes pieces of some units each, keyed by its document and their
place in the output; one shuffle by document and a sort within partitions (``repartition`` and
``sortWithinPartitions``, the DataFrame form of ``repartitionAndSortWithinPartitions``: Spark's sorter
spills) bring them in the order of the output, where they stream through a digest. No task holds a
document's output. The streamed pieces are keyed again by the section that the marks before them name, and
a second sort within the same partitions, without a shuffle, gives the text back. A plain text is its
own output, so its digest is taken where it is read and only that is sent.

A document's key is a hash of its id, its text and the partition that read it: rows that repeat an id with
another text are documents of their own, equal rows of a partition travel once and are counted, and a row
that is repeated very often is spread over as many keys as partitions read it. A null id is hashed as the
empty text, a null text is empty. An empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import pieces as slices

SEED, RATE, SPM = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Units of a piece, and bytes of a part of it (a unit may be long).
UNITS, BYTES = 4096, 1 << 18
#: Bytes of pieces that are gathered in one Arrow batch.
BATCH = 1 << 22

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The sections in the order of the text, and the order in which each form has them.
_ORDER = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
_FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}


def unit_ends(text: np.ndarray) -> np.ndarray:
    """Where each unit of a text of bytes ends."""
    space = _SPACE[text]
    last = ~space
    last[:-1] &= space[1:]
    ends = np.flatnonzero(last) + 1
    return np.append(ends, len(text)) if len(text) and space[-1] else ends


def plan(doc_id: object, text: bytes, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[str, np.ndarray, int, int]:
    """The form of a document, its units' ends, and the bytes at which middle and suffix begin."""
    ends = unit_ends(np.frombuffer(text, np.uint8))
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(ends)
    if not text or h[2] % 100 >= rate or any(m in text for m in _ORDER):
        return "plain", ends, 0, 0
    a, b = sorted(int(ends[k - 1]) if (k := x % (n + 1)) else 0 for x in h[:2])
    return ("spm" if h[3] % 100 < spm else "psm"), ends, a, b


def transform(doc_id: object, text: str | None, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[str, str]:
    """Form and output of one document, whole."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    form, _, a, b = plan(doc_id, raw, seed, rate, spm)
    parts = {PREFIX: raw[:a], MIDDLE: raw[a:b], SUFFIX: raw[b:]}
    out = raw if form == "plain" else b"".join(m + parts[m] for m in _FORMS[form])
    return form, out.decode("utf-8", "surrogatepass")


def restore(form: str, output: str) -> str:
    """The text of one output: the marks part its sections."""
    if form == "plain":
        return output
    first, second, third = (m.decode() for m in _FORMS[form])
    one, _, rest = output[len(first) :].partition(second)
    two, _, three = rest.partition(third)
    parts = {first: one, second: two, third: three}
    return "".join(parts[m.decode()] for m in _ORDER)


class _Rows:
    """Rows gathered as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int = 0):
        self.rows.append(row)
        self.size += 128 + size
        if self.size >= BATCH:
            yield self.batch()

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.schema.types)], schema=self.schema)


def _schema(*columns: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(columns))


_HEAD = (("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()))
_HEAD_DDL = "n long, form string, prefix_chars long, middle_chars long"


def _chars(text: memoryview) -> int:
    """Code points of a text in UTF-8."""
    return int(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).sum())


def _cut(text: memoryview, ends: np.ndarray, start: int, stop: int, units: int):
    """The pieces of ``text[start:stop]``: so many units each, long ones in parts."""
    low, high = np.searchsorted(ends, [start, stop], side="right")
    for at in [*ends[low + units - 1 : high : units].tolist(), stop]:
        while start < at:
            end = min(at, start + BYTES)
            yield bytes(text[start:end])
            start = end


def pieces(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, units: int = UNITS) -> DataFrame:
    """``key, place, doc_id, n, form, prefix_chars, middle_chars, digest, data``: the pieces of every output.

    The first row of a document (place 0) has what is known of it, and ``digest`` if it is plain; the
    others have the bytes of the output in ``data``, the marks as pieces of their own.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        here = TaskContext.get().partitionId()
        rows = None
        for b in slices(batches):
            if rows is None:
                rows = _Rows(_schema(("key", pa.binary()), ("place", pa.int64()), ("doc_id", b.schema.field("doc_id").type), *_HEAD, ("digest", pa.string()), ("data", pa.binary())))
            for doc_id, value in zip(b.column("doc_id").to_pylist(), b.column("text")):
                raw = value.as_buffer().to_pybytes() if value.is_valid else b""
                form, ends, start, stop = plan(doc_id, raw, seed, rate, spm)
                whole, text = hashlib.sha256(raw), memoryview(raw)
                key = hashlib.blake2b(repr((here, doc_id)).encode() + whole.digest(), digest_size=16).digest()
                if form == "plain":
                    yield from rows.add((key, 0, doc_id, len(ends), form, None, None, whole.hexdigest(), None))
                    continue
                yield from rows.add((key, 0, doc_id, len(ends), form, _chars(text[:start]), _chars(text[start:stop]), None, None))
                bounds = {PREFIX: (0, start), MIDDLE: (start, stop), SUFFIX: (stop, len(raw))}
                place = 0
                for mark in _FORMS[form]:
                    for data in (mark, *_cut(text, ends, *bounds[mark], units)):
                        place += 1
                        yield from rows.add((key, place, None, None, None, None, None, None, data), len(data))
        if rows is not None:
            yield rows.batch()

    return docs.select("doc_id", "text").mapInArrow(run, f"key binary, place long, doc_id {kind}, {_HEAD_DDL}, digest string, data binary")


def sorted_pieces(cut: DataFrame) -> DataFrame:
    """Pieces with all of a document in one partition, in the order of the output."""
    return cut.repartition("key").sortWithinPartitions("key", "place")


def _documents(batches):
    """Of pieces sorted by key and place: each document's first row, and its copies, then its other pieces.

    Yields ``(row, None)`` at a document's first row and ``(None, data)`` for each piece once; the last
    piece of equal rows stands for all, and ``row["copies"]`` counts them.
    """
    key = place = row = None
    for b in slices(batches, 4096):
        for r in b.to_pylist():
            if (r["key"], r["place"]) == (key, place):
                if place == 0:
                    row["copies"] += 1
                continue
            if r["key"] != key:
                row = r | {"copies": 1}
                yield row, None
            else:
                yield None, r["data"]
            key, place = r["key"], r["place"]


def digests(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, units: int = UNITS) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def assemble(batches):
        """Digests outputs, and gives their pieces the place that they have in the text."""
        schema = None
        row, digest, section, turn = None, None, None, 0

        def head():
            own = digest.hexdigest() if row["digest"] is None else row["digest"]
            return (row["key"], -1, 0, row["doc_id"], *(row[c] for c, _ in _HEAD), row["copies"], own, None)

        for b in batches:
            if schema is None:
                schema = _schema(("key", pa.binary()), ("section", pa.int32()), ("turn", pa.int64()), ("doc_id", b.schema.field("doc_id").type), *_HEAD, ("copies", pa.int64()), ("output_sha256", pa.string()), ("data", pa.binary()))
                rows, seen = _Rows(schema), _documents(_chain(b, batches))
                break
        else:
            return
        for first, data in seen:
            if first is not None:
                if row is not None:
                    yield from rows.add(head())
                row, digest, section, turn = first, hashlib.sha256(), None, 0
                continue
            digest.update(data)
            if data in _ORDER:
                section = _ORDER[data]
            else:
                turn += 1
                yield from rows.add((row["key"], section, turn, None, None, None, None, None, None, None, data), len(data))
        if row is not None:
            yield from rows.add(head())
        yield rows.batch()

    def rebuild(batches):
        """Digests texts: the pieces in the order of their sections."""
        schema, rows, head, digest = None, None, None, None

        def result():
            own = head["output_sha256"] if head["form"] == "plain" else digest.hexdigest()
            return (head["doc_id"], *(head[c] for c, _ in _HEAD), head["output_sha256"], own)

        for b in slices(batches, 4096):
            if schema is None:
                schema = _schema(("doc_id", b.schema.field("doc_id").type), *_HEAD, ("output_sha256", pa.string()), ("restored_sha256", pa.string()))
                rows = _Rows(schema)
            for r in b.to_pylist():
                if r["section"] < 0:
                    for _ in range(head["copies"] if head else 0):
                        yield from rows.add(result())
                    head, digest = r, hashlib.sha256()
                else:
                    digest.update(r["data"])
        if rows is not None:
            for _ in range(head["copies"] if head else 0):
                yield from rows.add(result())
            yield rows.batch()

    again = sorted_pieces(pieces(docs, seed, rate, spm, units)).mapInArrow(assemble, f"key binary, section int, turn long, doc_id {kind}, {_HEAD_DDL}, copies long, output_sha256 string, data binary")
    in_text_order = again.sortWithinPartitions("key", "section", "turn")  # a document's rows are in one partition already
    return in_text_order.mapInArrow(rebuild, f"doc_id {kind}, {_HEAD_DDL}, output_sha256 string, restored_sha256 string")


def _chain(first, rest):
    yield first
    yield from rest


def transformed(docs: DataFrame, columns: list[str], seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``columns`` of every document, with ``fim_form`` and ``fim_text``, its output whole, as training reads it."""
    extra = [c for c in ("doc_id", "text") if c not in columns]

    def run(batches):
        for b in slices(batches):
            both = [transform(i, t, seed, rate, spm) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())]
            own = [b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array([f for f, _ in both], pa.string()), pa.array([o for _, o in both], pa.string())], [*columns, "fim_form", "fim_text"])

    rows = docs.select(*columns, *extra)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return rows.mapInArrow(run, f"{fields}, fim_form string, fim_text string")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
     k AS (SELECT doc_id, text, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
     f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
     p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:n], ''), '') AS suffix FROM f),
     o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p),
     r AS (SELECT *, position('<P>' IN output) AS at_p, position('<S>' IN output) AS at_s, position('<M>' IN output) AS at_m FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars, sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
                        WHEN 'psm' THEN substr(output, 4, at_s - 4) || substr(output, at_m + 3) || substr(output, at_s + 3, at_m - at_s - 3)
                        ELSE substr(output, at_p + 3, at_m - at_p - 3) || substr(output, at_m + 3) || substr(output, 4, at_p - 4) END) AS restored_sha256
FROM r
"""
