"""Media columns: payloads stored as FLAC streams and read back as PCM blocks with seekable sample offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweave.llm import flac
from chronoweave.session import read_table, small_batches

#: Frames of a PCM block: 49,152 samples.
BLOCK_FRAMES = 256


def padded_payload(text: Column, unit: int = flac.BLOCK) -> Column:
    """The text's UTF-8 bytes, null as none, with spaces up to a positive multiple of unit."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.octet_length(data)
    whole = F.greatest(F.lit(unit), F.ceil(size / unit).cast("int") * unit)
    return F.concat(data, F.encode(F.repeat(F.lit(" "), (whole - size).cast("int")), "UTF-8"))


def encode_column(df: DataFrame, payload: str, media: str = "media", lpc_order: int = flac.LPC_ORDER) -> DataFrame:
    """df with `media`, the FLAC stream of each payload (bytes as unsigned 8-bit samples), in place of the payload.

    A payload's length must be a positive multiple of 192; a null payload gives null, and an empty table an empty one.
    Streams are made slab by slab, so a worker holds a few hundred thousand samples besides the batch itself. A column of
    df that is named as media is replaced; all others pass through.
    """
    small_batches(df.sparkSession)
    rest = [c for c in df.columns if c not in (payload, media)]
    schema = T.StructType([*df.select(*rest).schema.fields, T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, len(rest)):
                values = part.column(len(rest)).to_pylist()
                made = flac.encode([v for v in values if v is not None], lpc_order)
                out = pa.array([None if v is None else next(made) for v in values], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], out], [*rest, media])

    return df.select(*rest, payload).mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes in a column, at least a row each."""
    sizes = np.array([0 if not v.is_valid else v.as_buffer().size for v in batch.column(column)], dtype=np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


BLOCKS = T.ArrayType(T.StructType().add("sample_offset", "long").add("n_samples", "integer").add("pcm", "binary").add("level", "long").add("turns", "long"))


def decode_column(df: DataFrame, media: str = "media", blocks: str = "blocks", block_frames: int = BLOCK_FRAMES, error: str | None = None) -> DataFrame:
    """df with `blocks`: each stream's samples as PCM blocks, unsigned 8 bits, by offset of their first sample.

    Every frame's header and body checksums, the number of samples and the stream's MD5 are verified. A stream that
    fails any stops the job, or, if `error` names a column for it, has null blocks and says there what was wrong. level is the sum of a block's distances from the middle and turns its
    number of sign changes. A null stream gives null. The stream itself stays, for seeking with flac.decode_from. Columns
    of df that are named as blocks or error are replaced; all others pass through.
    """
    df = df.drop(*[c for c in (blocks, error) if c])
    schema = T.StructType([*df.schema.fields, T.StructField(blocks, BLOCKS), *([T.StructField(error, T.StringType())] if error else [])])
    names = schema.names
    at = df.columns.index(media)
    kind = pa.list_(pa.struct([("sample_offset", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary()), ("level", pa.int64()), ("turns", pa.int64())]))

    def cut(samples: bytes) -> list[dict]:
        out, step = [], block_frames * flac.BLOCK
        for start in range(0, len(samples), step):
            pcm = samples[start : start + step]
            x = np.frombuffer(pcm, dtype=np.uint8).astype(np.int16) - 128
            out.append({"sample_offset": start, "n_samples": len(pcm), "pcm": pcm, "level": int(np.abs(x).sum(dtype=np.int64)), "turns": int(((x[1:] < 0) != (x[:-1] < 0)).sum())})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, at):
                values = part.column(at).to_pylist()
                if error:
                    read = [(None, None) if v is None else flac.attempt(v) for v in values]
                    told = [pa.array([None if x is None else cut(x) for x, _ in read], kind), pa.array([e for _, e in read], pa.string())]
                else:
                    made = flac.decode([v for v in values if v is not None])
                    told = [pa.array([None if v is None else cut(next(made)) for v in values], kind)]
                yield pa.RecordBatch.from_arrays([*part.columns, *told], names)

    return df.mapInArrow(run, schema)


def op4_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text is empty text, so every document has a payload of at least 192 samples."""
    docs = read_table(spark, sf_dir, "documents")
    size = F.octet_length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long")
    media = encode_column(docs.select("doc_id", size.alias("n_bytes"), padded_payload(F.col("text")).alias("payload")), "payload")
    read = decode_column(media)
    payload = F.aggregate("blocks", F.lit(b""), lambda acc, b: F.concat(acc, b["pcm"]))
    total = lambda field: F.aggregate("blocks", F.lit(0).cast("long"), lambda acc, b: acc + b[field])
    back = read.select("doc_id", "n_bytes", "media", payload.alias("payload"), F.size("blocks").alias("n_blocks"), total("level").alias("level"), total("turns").alias("turns"))
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.concat(F.lit("blocks="), "n_blocks"), F.concat(F.lit("level="), "level"), F.concat(F.lit("turns="), "turns")).alias("feature"),
    )
