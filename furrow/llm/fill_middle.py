"""Fill-in-middle transformation over seekable frames (operator 11).

``store`` turns texts into compressed frames with cumulative unit counts.
``fill_in_middle`` draws two cuts and a form for each row, finds the cuts by
decompressing only the frames that hold them, and writes the output, in the
order of its form, as frames again. ``digests`` streams the output's frames
in order. No step shuffles, and a row never has more than a frame of text
uncompressed once it is stored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from furrow.llm.common import batches, fresh
from furrow.llm.frames import FRAME, SCHEMA, Frames

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Share in a hundred of texts that are cut, and of these in suffix-first form.
CUT, SUFFIX_FIRST = 50, 80
SEED = 42
#: Bytes of Arrow rows that a task turns into Python rows at once.
PIECE_BYTES = 8 << 20


def _added(df: DataFrame, fields: list[T.StructField], make) -> DataFrame:
    """``df`` with columns that ``make`` gives, a tuple per row of a record
    batch; columns of those names are replaced."""
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(rows):
        step = make()
        for b in rows:
            for piece in batches([b], PIECE_BYTES):
                values = list(zip(*step(piece))) or [()] * len(fields)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(f.name) for f in kept] + [pa.array(list(v), k) for v, k in zip(values, kinds)],
                    names=[f.name for f in kept] + [f.name for f in fields])

    return df.mapInArrow(run, T.StructType(kept + fields))


def store(df: DataFrame, text: str = "text", out: str = "frames", marked: str = "marked", size: int = FRAME) -> DataFrame:
    """Add ``out``, the frames of each whole text, and ``marked``, whether it
    contains one of the marks. Null and empty texts have no frames. Other
    columns pass through, columns of those names are replaced."""

    def make():
        frames = Frames(size)

        def step(piece):
            for raw in piece.column(text).cast(pa.large_binary()).to_pylist():
                yield frames.write([raw] if raw else []), bool(raw) and any(m in raw for m in MARKS)
        return step

    return _added(df, [T.StructField(out, SCHEMA), T.StructField(marked, T.BooleanType())], make)


def draws(key: Column, seed: int = SEED) -> Column:
    """Four unsigned numbers of 32 bits from the hash of seed and key; a null
    key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def _parts(form: str, prefix: tuple, middle: tuple, suffix: tuple) -> list:
    """Marks and (start, stop) spans in the order of the form."""
    if form == "psm":
        return [PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle]
    return [SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle]


def fill_in_middle(df: DataFrame, key: str = "doc_id", frames: str = "frames", marked: str = "marked", seed: int = SEED,
                   size: int = FRAME) -> DataFrame:
    """Add ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars`` and
    ``middle_chars`` (code points, null if plain) and ``output``, the frames
    of the transformed text.

    The cuts, and the form, depend on seed and key alone, so repeated rows
    and reruns agree. Texts that are empty or contain a mark stay plain, with
    the text's own frames as output. Columns of those names are replaced,
    others pass through; an empty table gives an empty table.
    """
    draw = fresh(df, "__draw")

    def make():
        store_ = Frames(size)

        def step(piece):
            cells = (piece.column(c).to_pylist() for c in (frames, marked, draw))
            for fs, mark, (h1, h2, h3, h4) in zip(*cells):
                n = fs[-1]["units"] if fs else 0
                if not fs or mark or h3 % 100 >= CUT:
                    yield n, "plain", None, None, fs or []
                    continue
                a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                (at, first), (to, second) = store_.place(fs, a), store_.place(fs, b)
                form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
                parts = _parts(form, (0, at), (at, to), (to, fs[-1]["bytes"]))
                text = (raw for p in parts for raw in ([p] if isinstance(p, bytes) else store_.read(fs, *p)))
                yield n, form, first, second - first, store_.write(_whole(text))
        return step

    fields = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
              T.StructField("middle_chars", T.LongType()), T.StructField("output", SCHEMA)]
    return _added(df.withColumn(draw, draws(F.col(key), seed)), fields, make).drop(draw)


def _whole(parts):
    """The parts without empty ones (cuts lie between code points)."""
    return (p for p in parts if p)


def restored(frames: Frames, output: list[dict], form: str):
    """The text behind an output, read in its order from the output's frames
    and the form alone, a frame at a time."""
    if form == "plain":
        yield from frames.read(output)
        return
    at, end = frames.find(output, MARKS), output[-1]["bytes"] if output else 0
    after = sorted([*at.values(), end])
    for m in (PREFIX, MIDDLE, SUFFIX):
        start = at[m] + len(m)
        yield from frames.read(output, start, after[after.index(at[m]) + 1] if m != MIDDLE else end)


def digests(df: DataFrame, output: str = "output", form: str = "form", size: int = FRAME) -> DataFrame:
    """Add ``output_sha256`` and ``restored_sha256``, hexadecimal digests of
    the output and of the text rebuilt from it."""

    def make():
        frames = Frames(size)

        def step(piece):
            for out, kind in zip(piece.column(output).to_pylist(), piece.column(form).to_pylist()):
                whole, back = hashlib.sha256(), hashlib.sha256()
                for raw in frames.read(out or []):
                    whole.update(raw)
                for raw in restored(frames, out or [], kind):
                    back.update(raw)
                yield whole.hexdigest(), back.hexdigest()
        return step

    return _added(df, [T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())], make)


def texts(df: DataFrame, frames: str = "output", out: str = "text") -> DataFrame:
    """Add ``out``, the whole text of the frames."""

    def make():
        store_ = Frames()

        def step(piece):
            for fs in piece.column(frames).to_pylist():
                yield (b"".join(store_.read(fs or [])).decode(),)
        return step

    return _added(df, [T.StructField(out, T.StringType())], make)


#: The same rows in DuckDB's SQL. Its pattern has no look-around, none is needed.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
r AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid,
         coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
