"""BPE encoding and decoding over a distinct-word table.

1. Spark splits every text into words. A block of documents (an Arrow batch) is stored as its own
   list of distinct words and, per document, the words' numbers in that list by position.
2. The blocks' word lists meet by a hash of the word: each distinct word is encoded once, however
   many of ``GROUP_BLOCKS`` blocks (8 billion words) have it, and every block gets the ids of its words back.
3. Each block's ids are joined to its documents by position.

Texts cross the shuffle only as compressed word numbers; a word is shuffled once per block that
has it. Beyond ``GROUP_BLOCKS`` blocks further groups of blocks have word tables of their own, so
that what one task holds does not grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenfold.llm.common import releasing, written_in_buckets
from tokenfold.llm.vocabulary import SETTLED, WORDS, Vocabulary, java_class

#: Words of texts from which a block is closed.
BLOCK_WORDS = 2_000_000

#: Blocks whose words meet. A word that every block has comes so many times to one task at most.
GROUP_BLOCKS = 4096

#: Documents that Spark hands to a task at a time; a block gathers several such batches.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500"}

#: Words from all blocks that one task of step 2 takes.
BUCKET_WORDS = 400_000

#: Pieces that a task of step 3 puts together at once.
SLICE_WORDS = 100_000

#: Separates words where they are stored together; this byte is never part of UTF-8.
SEPARATOR = b"\xff"


def pack(values) -> bytes:
    """Non-negative integers below 2**32 as compressed byte planes."""
    import numpy as np
    import zstandard

    planes = np.ascontiguousarray(np.asarray(values, "<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _shrink(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _grow(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _own_words(tokenizer, text: str) -> list[str]:
    """The words of a text as the tokenizers library splits it, special strings being words."""
    found = tokenizer.encode(text, add_special_tokens=False)
    spans: list[list[int]] = []
    last = None
    for word, (a, b) in zip(found.word_ids, found.offsets):
        if word != last or not spans:
            spans.append([a, b])
            last = word
        else:
            spans[-1][1] = max(b, spans[-1][1])
    return [text[a:b] for a, b in spans]


def _blocks(path: str, id_type: pa.DataType):
    """Arrow batches of (id, words or null, text where words are null) to one row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, size = TaskContext.get().partitionId(), 0, 0
        ids: list[pa.Array] = []
        lists: list[pa.Array] = []
        for batch in batches:
            words = batch.column(1)
            if words.null_count:
                tokenizer, texts = Vocabulary(path).tokenizer, batch.column(2)
                own = [w.as_py() if w.is_valid else _own_words(tokenizer, t.as_py()) for w, t in zip(words, texts)]
                words = pa.array(own, pa.list_(pa.string()))
            ids.append(batch.column(0))
            lists.append(words)
            size += len(words.flatten())
            if size >= BLOCK_WORDS:
                yield _block((task << 32) | made, ids, lists, id_type)
                ids, lists, size, made = [], [], 0, made + 1
        if ids:
            yield _block((task << 32) | made, ids, lists, id_type)

    return run


def _block(block: int, ids: list[pa.Array], lists: list[pa.Array], id_type: pa.DataType) -> pa.RecordBatch:
    """A block's row: its documents, their words by number, and the distinct words, frequent ones first."""
    import numpy as np

    coded = pa.chunked_array([x.flatten() for x in lists], pa.string()).dictionary_encode().combine_chunks()
    sizes = [n for x in lists for n in x.value_lengths().to_pylist()]
    codes, words = coded.indices.to_numpy(), coded.dictionary
    order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), np.uint32)
    rank[order] = np.arange(len(words), dtype=np.uint32)
    joined = SEPARATOR.join(words.take(pa.array(order)).cast(pa.binary()).to_pylist())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block]),
            pa.array([[i for x in ids for i in x.to_pylist()]], pa.list_(id_type)),
            pa.array([sizes], pa.list_(pa.int64())),
            pa.array([pack(rank[codes])], pa.binary()),
            pa.array([len(words)]),
            pa.array([_shrink(joined)], pa.binary()),
        ],
        ["block", "ids", "sizes", "numbers", "n_words", "words"],
    )


def _deal(buckets: int, groups: int):
    """A block's word list to its parts by a hash of the word; ``gaps`` are the steps between numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for batch in batches:
            for block, count, data in zip(*(batch.column(i) for i in range(3))):
                if not count.as_py():
                    continue
                words = np.array(_grow(data.as_py()).split(SEPARATOR), object)
                bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
                rows = []
                for a, b in zip(edges, [*edges[1:], len(order)]):
                    own = order[a:b]
                    rows.append((int(bucket[own[0]]), pack(np.diff(own, prepend=0)), _shrink(SEPARATOR.join(words[own]))))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] * groups + xxhash.xxh3_64_intdigest(str(block)) % groups for r in rows]), pa.array([block.as_py()] * len(rows)),
                        pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()),
                    ],
                    ["bucket", "block", "gaps", "words"],
                )

    return run


def _encode_bucket(path: str):
    """All blocks' words of one bucket: each distinct word is encoded once."""

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        lists = [_grow(x.as_py()).split(SEPARATOR) for x in table.column("words")]
        every = pa.array([w for part in lists for w in part], pa.binary()).cast(pa.string()).dictionary_encode()
        distinct = every.dictionary.to_pylist()
        tokenizer = Vocabulary(path).tokenizer
        ids: list[list[int]] = []
        for at in range(0, len(distinct), 20_000):
            ids += [e.ids for e in tokenizer.encode_batch_fast(distinct[at : at + 20_000], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
        codes, at = every.indices.to_numpy(), 0
        packed_sizes, packed_ids = [], []
        for part in lists:
            own = codes[at : at + len(part)]
            at += len(part)
            packed_sizes.append(pack(sizes[own]))
            packed_ids.append(pack(gather(flat, sizes, own)))
        return pa.table(
            {
                "block": table.column("block"), "gaps": table.column("gaps"),
                "sizes": pa.array(packed_sizes, pa.binary()), "ids": pa.array(packed_ids, pa.binary()),
            }
        )

    return run


def gather(flat, sizes, codes):
    """The entries of ``flat`` that belong to ``codes``, in order; entry c of it has sizes[c] values."""
    import numpy as np

    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    own = sizes[codes]
    shift = starts[codes] - (np.cumsum(own, dtype=np.int64) - own)
    where = np.repeat(shift, own)
    where += np.arange(len(where))
    return flat[where]


def _decoded(pieces: pa.BinaryArray, ids, bounds: list[int]) -> list[str]:
    """The texts of consecutive runs of ids: piece by id, joined, read as UTF-8."""
    import numpy as np

    joined = pieces.take(pa.array(ids.astype(np.int64)))
    _, ends, data = joined.buffers()
    ends = np.frombuffer(ends, np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
    held = memoryview(data) if data is not None else memoryview(b"")
    cuts = ends[bounds].tolist()
    return [str(held[a:b], "utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


def _put_together(pieces: list[bytes] | None, schema: pa.Schema):
    """A block's ids by word number to its documents' ids, and by ``pieces`` to their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = None if pieces is None else pa.array(pieces, pa.binary())
        for batch in batches:
            for doc_ids, lengths, data, parts in zip(*(batch.column(i) for i in range(4))):
                words = unpack(data.as_py())
                ends = np.cumsum(lengths.values.to_numpy())
                flat, by_number = _by_number(parts.values) if parts.is_valid else (np.zeros(0, np.uint32),) * 2
                at = 0
                while at < len(ends):
                    done = int(ends[at - 1]) if at else 0
                    to = max(at + 1, int(np.searchsorted(ends, done + SLICE_WORDS, "right")))
                    own = words[done : int(ends[to - 1])]
                    tokens = gather(flat, by_number, own).astype("<u4", copy=False)
                    cuts = np.concatenate(([0], np.cumsum(by_number[own], dtype=np.int64)))[ends[at:to] - done]
                    bounds = np.concatenate(([0], cuts)).tolist()
                    held = tokens.tobytes()
                    columns = [
                        doc_ids.values.slice(at, to - at),
                        pa.array([b - a for a, b in zip(bounds, bounds[1:])], pa.int64()),
                        pa.array([held[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:])], pa.binary()),
                    ]
                    if table is not None:
                        columns.append(pa.array(_decoded(table, tokens, bounds), pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
                    at = to
                del words, flat, by_number
                pa.default_memory_pool().release_unused()

    return run


def _by_number(parts: pa.StructArray):
    """The buckets' parts of one block as all ids in order of the word's number, and how many each has."""
    import numpy as np

    gaps, sizes, ids = ([unpack(x.as_py()) for x in parts.field(k)] for k in ("gaps", "sizes", "ids"))
    order = np.argsort(np.concatenate([np.cumsum(g) for g in gaps]), kind="stable")
    all_sizes = np.concatenate(sizes)
    return gather(np.concatenate(ids), all_sizes, order), all_sizes[order]


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """One row per document row: doc_id, n_tokens and ids (little-endian unsigned 32-bit, as binary).

    With ``decoded`` also the text that ``decode`` makes of the ids, while they are at hand.

    The ids are those of the tokenizers library for the file at ``path`` without added special
    tokens, truncation or padding; special strings inside a text are recognised as by its default.
    Null and empty texts have no ids; repeated rows each get theirs; null ids stay null; further
    columns are ignored. A very long text is a block of its own.

    The blocks are written once to the shared folder, since their numbering must not change when
    a lost task is run again, in buckets, so that only the words' ids are shuffled to them.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    vocabulary = Vocabulary(path)
    id_field = docs.schema["doc_id"].dataType
    id_arrow = to_arrow_type(id_field)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = ~text.rlike(f"[^{java_class(SETTLED)}]")
    for special in vocabulary.specials:
        plain = plain & ~F.contains(text, F.lit(special))
    split = docs.select(
        "doc_id",
        F.when(plain, F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))).alias("words"),
        F.when(~plain, text).alias("text"),
    )
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_field)),
            T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("numbers", T.BinaryType()),
            T.StructField("n_words", T.LongType()), T.StructField("words", T.BinaryType()),
        ]
    )
    blocks = written_in_buckets(split.mapInArrow(releasing(_blocks(path, id_arrow)), schema), "blocks", "block", BATCH)
    count, total = blocks.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    groups = -(-count // GROUP_BLOCKS) or 1
    buckets = -(-total // (BUCKET_WORDS * groups)) or 1
    dealt = blocks.select("block", "n_words", "words").mapInArrow(
        releasing(_deal(buckets, groups)), "bucket long, block long, gaps binary, words binary"
    )
    coded = dealt.groupBy("bucket").applyInArrow(
        _encode_bucket(path), "block long, gaps binary, sizes binary, ids binary"
    )
    out = T.StructType(
        [T.StructField("doc_id", id_field), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    )
    arrow = pa.schema([("doc_id", id_arrow), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    if decoded:
        out = out.add("decoded", T.StringType())
        arrow = arrow.append(pa.field("decoded", pa.string()))
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = coded.repartition(count, "block").groupBy("block").agg(F.collect_list(F.struct("gaps", "sizes", "ids")).alias("parts"))
    own = blocks.select("block", "ids", "sizes", "numbers")
    whole = own.join(parts.hint("shuffle_hash"), "block", "left")
    return whole.select("ids", "sizes", "numbers", "parts").mapInArrow(releasing(_put_together(vocabulary.pieces() if decoded else None, arrow)), out)


def _decode(path: str, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        pieces = pa.array(Vocabulary(path).pieces(), pa.binary())
        for batch in batches:
            texts: list[str] = []
            for value in batch.column(at):
                ids = np.frombuffer(value.as_py() or b"", "<u4")
                texts += _decoded(pieces, ids, [0, len(ids)])
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``: the text of its ``ids``, special tokens included.

    Ids are joined to the table of id and piece by position. That table is the vocabulary, whose
    size is the tokenizer file's, whatever the data; every worker has it. Bytes that are not UTF-8
    become replacement characters, as the library has it. Null or no ids give the empty text.
    """
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    return encoded.mapInArrow(releasing(_decode(path, encoded.columns.index("ids"))), schema)
