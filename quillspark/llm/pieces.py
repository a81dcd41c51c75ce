"""SentencePiece encoding by the model's merges, and decoding.

A text becomes code points: a leading mark, spaces as marks, all else as it is. Its encoding is what the model's
merges make of it: of all neighbours that together are a piece, the pair with the best score is joined first, the
leftmost of equal ones. Code points without a piece are spelled in byte pieces.

No merge joins two code points that stand side by side in no piece. There a text falls into segments (a word, or
less) that are encoded on their own: the distinct segments of many texts at once, and remembered.

Giant documents are split into chunks of whole segments, encoded apart, and their ids put together in order. The
largest sum of scores, which a max-plus scan over chunks would give, is another encoding: a merge model's scores are
ranks, not log probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import bounded_batches, named, whole
from quillspark.llm.words import mix
from quillspark.session import materialize

CHUNK = 32_768
GROUP = 1 << 19
PAIR_BITS = 22
#: Segments whose encodings a task remembers, and ids of these; beyond it starts anew.
REMEMBERED, POOLED = 400_000, 8_000_000
MARK = 0x2581
#: Stands for a mark that the text itself holds; beyond Unicode, so it has no piece and is spelled in bytes.
OWN_MARK = 0x110000
_BASE = 0xC2B2AE3D27D4EB4F
_LOW = -1e300
#: Model files give this score or less to pieces that are never to be chosen.
NEVER = -1e8


class Vocabulary:
    """Merges, scores and byte pieces of a model file, and the neighbours that its pieces hold."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        rules = proto.normalizer_spec
        if rules.name != "identity" or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("models that change a text before they encode it are not supported")
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE:
            raise ValueError("the model needs merges")
        rules.add_dummy_prefix = False  # the mark is among the code points
        self.model = model = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.bytes = np.zeros(256, dtype=np.int32)
        n_bytes, pieces = 0, []
        self.scores = np.zeros(model.get_piece_size())
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.scores[i] = model.get_score(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)], n_bytes = i, n_bytes + 1
            elif not (model.is_control(i) or model.is_unknown(i)):
                pieces.append((piece, i))
        if n_bytes != 256:
            raise ValueError("the model needs a piece for every byte")
        if any(chr(MARK) in p.lstrip(chr(MARK)) for p, _ in pieces):
            raise ValueError("pieces that reach past the start of a word are not supported")
        scored = self.scores[[i for _, i in pieces]]
        self.byte_score = float(scored[scored > NEVER].min()) - 10.0
        self.scores[self.bytes] = self.byte_score
        self.scores = np.maximum(self.scores, self.byte_score)
        # a bitmap by hash: of other neighbours few pass, and these only make a segment longer
        self.pairs = np.zeros(1 << PAIR_BITS, dtype=bool)
        for p, _ in pieces:
            x = self.codes(p, raw=True)
            self.pairs[self._pair(x)] = True
        power = np.full(GROUP + 1, _BASE, dtype=np.uint64)
        inverse = np.full(GROUP + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        power[0] = inverse[0] = 1
        self.power, self.inverse = np.cumprod(power), np.cumprod(inverse)

    @staticmethod
    def _pair(x: np.ndarray) -> np.ndarray:
        """Bucket of each code point with the next one."""
        y = x.astype(np.uint64)
        return ((y[:-1] << np.uint64(21) | y[1:]) * np.uint64(_BASE)) >> np.uint64(64 - PAIR_BITS)

    def starts(self, x: np.ndarray) -> np.ndarray:
        """Starts of segments, the start of the sequence included."""
        fresh = np.ones(len(x), dtype=bool)
        if len(x) > 1:
            fresh[1:] = ~self.pairs[self._pair(x)] | (x[1:] == OWN_MARK) | (x[:-1] == OWN_MARK)
        return np.flatnonzero(fresh)

    def start_from(self, text: str, at: int) -> int:
        """The first start of a segment of ``text`` at ``at`` (above 0) or later; its length without any."""
        step = 256
        while at < len(text):
            found = self.starts(self.codes(text[at - 1 : at + step], first=False))
            if len(found) > 1:
                return at - 1 + int(found[1])
            at, step = at + step, min(step * 2, GROUP)
        return len(text)

    @staticmethod
    def codes(text: str, raw: bool = False, first: bool = True) -> np.ndarray:
        """Code points of a text as encoded; ``first``: with the leading mark."""
        x = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        if raw:
            return x
        x = np.where(x == MARK, OWN_MARK, np.where(x == 0x20, MARK, x)).astype(np.uint32)
        return np.concatenate([np.array([MARK], dtype=np.uint32), x]) if first and len(x) else x


class Decoder:
    """Texts of ids: the bytes of each piece of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        table = [p.replace(chr(MARK), " ").encode() for p in map(model.id_to_piece, range(model.get_piece_size()))]
        for i in range(len(table)):
            if model.is_byte(i):
                table[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
            elif model.is_control(i) or model.is_unknown(i):
                table[i] = b""
        self.table = table

    def decode(self, ids: Sequence[int]) -> str:
        """The text of an encoding, without its leading mark. Bytes that are not UTF-8 are replaced."""
        table = self.table
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Encoder:
    """Encodings of sequences of code points."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self._forget()

    # Segments that were met before.

    def _forget(self) -> None:
        """Remembered segments, sorted by hash: where their ids stand in ``pool``, how many, and their scores."""
        self.known = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.pool = [np.zeros(0, dtype=np.int32)]
        self.pooled = 0

    def _remember(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, scores: np.ndarray) -> None:
        """Add segments given in the order of their hashes, none of them known yet."""
        at = self.pooled + np.cumsum(sizes) - sizes
        place = np.searchsorted(self.known[0], hashes)
        self.known = tuple(np.insert(a, place, b) for a, b in zip(self.known, (hashes, at, sizes, scores), strict=True))
        self.pool.append(ids)
        self.pooled += len(ids)

    def _lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes among the known segments, and which of them are known."""
        place = np.searchsorted(self.known[0], hashes)
        if not len(self.known[0]):
            return place, np.zeros(len(hashes), dtype=bool)
        return place, self.known[0][np.minimum(place, len(self.known[0]) - 1)] == hashes

    # Segments.

    def _solve(self, x: np.ndarray, lens: np.ndarray):
        """Encodings of segments given end to end: (ids, ids of each segment, score of each segment)."""
        own = x == OWN_MARK
        text = np.where(own, 0, np.where(x == MARK, 0x20, x)).astype(np.uint32).tobytes().decode("utf-32-le")
        ends = np.cumsum(lens)
        found = self.v.model.encode([text[a:b] for a, b in zip((ends - lens).tolist(), ends.tolist(), strict=True)])
        for k in np.flatnonzero(own[ends - lens]).tolist():  # a segment of its own
            found[k] = self.v.bytes[list(chr(MARK).encode())].tolist()
        sizes = np.array([len(f) for f in found], dtype=np.int64)
        ids = np.fromiter((i for f in found for i in f), dtype=np.int32, count=int(sizes.sum()))
        totals = np.concatenate([[0.0], np.cumsum(self.v.scores[ids])])
        last = np.cumsum(sizes)
        return ids, sizes, totals[last] - totals[last - sizes]

    def _long_word(self, x: np.ndarray):
        """Encoding of a sequence in one go, cut nowhere but at the text's own marks."""
        own = np.flatnonzero(x == OWN_MARK)
        starts = np.unique(np.concatenate([[0], own, own + 1]))
        starts = starts[starts < len(x)]
        ids, _, scores = self._solve(x, np.diff(np.concatenate([starts, [len(x)]])))
        return ids, float(scores.sum())

    # Texts and parts of texts.

    def encode(self, units: Sequence[np.ndarray]) -> list[tuple[np.ndarray, float]]:
        """Ids and score of each sequence of code points; sequences are solved together up to ``GROUP``."""
        out: list[tuple[np.ndarray, float]] = []
        group: list[np.ndarray] = []
        held = 0
        for x in units:
            if group and held + len(x) > GROUP:
                out += self._group(group)
                group, held = [], 0
            group.append(x)
            held += len(x)
        return out + (self._group(group) if group else [])

    def _group(self, group: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
        if len(group) == 1 and len(group[0]) > GROUP:
            return [self._in_parts(group[0])]
        x = np.concatenate(group)
        if not len(x):
            return [(np.zeros(0, dtype=np.int32), 0.0)] * len(group)
        unit_at = np.concatenate([[0], np.cumsum([len(g) for g in group])])
        starts = np.unique(np.concatenate([self.v.starts(x), unit_at[:-1][unit_at[:-1] < len(x)]]))
        lens = np.diff(np.concatenate([starts, [len(x)]]))
        sums = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(x.astype(np.uint64) * self.v.power[: len(x)], out=sums[1:])
        hashes = mix((sums[starts + lens] - sums[starts]) * self.v.inverse[starts] + lens.astype(np.uint64))
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known[0]) > REMEMBERED or self.pooled > POOLED:
            self._forget()
        fresh = np.flatnonzero(~self._lookup(distinct)[1])
        take = lens[first[fresh]]
        place = np.repeat(starts[first[fresh]] - (np.cumsum(take) - take), take) + np.arange(take.sum())
        self._remember(distinct[fresh], *self._solve(x[place], take))
        if len(self.pool) > 1:
            self.pool = [np.concatenate(self.pool)]
        known = self._lookup(distinct)[0]
        _, at, sizes, scores = (k[known] for k in self.known)
        counts = sizes[inverse]
        ends = np.cumsum(counts)
        every = self.pool[0][np.repeat(at[inverse] - (ends - counts), counts) + np.arange(counts.sum())]
        word_bounds = np.searchsorted(starts, unit_at)
        ends, totals = np.concatenate([[0], ends]), np.concatenate([[0.0], np.cumsum(scores[inverse])])
        return [
            (every[ends[a] : ends[b]], float(totals[b] - totals[a]))
            for a, b in zip(word_bounds[:-1], word_bounds[1:], strict=True)
        ]

    def _in_parts(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """A sequence longer than a group, cut at starts of segments; one that fills a group is solved by itself."""
        starts = self.v.starts(x)
        found, at = [], 0
        while at < len(x):
            stop = int(starts[np.searchsorted(starts, at + GROUP, side="right") - 1])
            if len(x) - at <= GROUP:
                stop = len(x)
            if stop <= at:
                later = starts[starts > at]
                stop = int(later[0]) if len(later) else len(x)
                found.append(self._long_word(x[at:stop]))
            else:
                found += self._group([x[at:stop]])
            at = stop
        return np.concatenate([f[0] for f in found]), float(sum(f[1] for f in found))


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of max-plus matrices, or of equally long stacks of them. Associative."""
    return np.maximum((a[..., :, :, None] + b[..., None, :, :]).max(axis=-2), _LOW)


def scan(matrices: np.ndarray) -> np.ndarray:
    """Products of all prefixes of a stack of matrices: doubling steps, each over the whole stack at once."""
    out, step = matrices.copy(), 1
    while step < len(out):
        fresh = out.copy()
        for a in range(step, len(out), 1024):  # bounded work memory
            b = min(a + 1024, len(out))
            fresh[a:b] = max_plus(out[a - step : b - step], out[a:b])
        out, step = fresh, step * 2
    return out


def encode_documents(
    docs: DataFrame, model: str, chunk: int = CHUNK, text: str = "text"
) -> DataFrame:
    """``docs`` with ``text`` replaced by ``n_tokens``, ``score`` and ``ids``; ``model`` is a path all executors can open.

    * Null or empty text: no ids, score 0.
    * The ids are those that the model's merges give. ``score`` is the sum of their scores in the model; byte pieces,
      and pieces that the model gives no proper score, count 10 less than the lowest one.
    * Texts of more than ``chunk`` code points are encoded in chunks that end where a segment does. One segment is one
      step, however long.
    * Every row is encoded by its whole text, equal texts of one kind alike. An empty table gives no rows.
    * Other columns stay; columns of the names added here are replaced, and names with a leading underscore
      (``_row _chunk _part _carry``) are the operator's own.
    """
    bounded_batches(docs.sparkSession)
    added = ("n_tokens", "score", "ids")
    carried = [c for c in docs.columns if c != text and c not in added]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *named(carried)).alias("_carry"), whole(text).alias("_text"))
    is_long = F.length("_text") > chunk
    carry = T.StructType([T.StructField("_carry", rows.schema["_carry"].dataType, True)])
    encoded = T._parse_datatype_string("n_tokens bigint, score double, ids array<int>")
    schema = lambda ddl, *more: T.StructType(sum((p.fields for p in more), T._parse_datatype_string(ddl).fields if ddl else []))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            found = encoder.encode([encoder.v.codes(t) for t in batch.column("_text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("_carry"), *_columns(found)], ["_carry", *added])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(model)
        for batch in batches:
            for i, (row, whole_text) in enumerate(zip(batch.column("_row").to_pylist(), batch.column("_text").to_pylist(), strict=True)):
                bounds = [0]
                while bounds[-1] < len(whole_text):
                    bounds.append(v.start_from(whole_text, bounds[-1] + chunk))
                for a in range(0, len(bounds) - 1, 64):
                    some = list(range(a, min(a + 64, len(bounds) - 1)))
                    arrays = [
                        pa.array([row] * len(some), pa.int64()), pa.array(some, pa.int32()),
                        pa.array([whole_text[bounds[k] : bounds[k + 1]] for k in some], pa.string()),
                        batch.column("_carry").take(pa.array([i if k == 0 else None for k in some], pa.int32())),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, ["_row", "_chunk", "_part", "_carry"])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            numbers, parts = (batch.column(c).to_pylist() for c in ("_chunk", "_part"))
            found = encoder.encode([encoder.v.codes(p, first=k == 0) for k, p in zip(numbers, parts, strict=True)])
            kept = [batch.column("_row"), batch.column("_chunk"), batch.column("_carry")]
            yield pa.RecordBatch.from_arrays([*kept, *_columns(found)], ["_row", "_chunk", "_carry", *added])

    direct = rows.where(~is_long).mapInArrow(short, schema("", carry, encoded))
    chunks = materialize(
        rows.where(is_long).withColumn("_row", F.monotonically_increasing_id())
        .mapInArrow(split, schema("_row bigint, _chunk int, _part string", carry))
    )
    # spread over tasks whatever the layout of the documents was
    parts = chunks.repartition("_row", "_chunk").mapInArrow(apart, schema("_row bigint, _chunk int", carry, encoded))
    long = parts.groupBy("_row").agg(
        F.first("_carry", ignorenulls=True).alias("_carry"), F.sum("n_tokens").alias("n_tokens"), F.sum("score").alias("score"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "ids"))), lambda p: p["ids"])).alias("ids"),
    ).drop("_row")
    return direct.unionByName(long).select(*[F.col("_carry")[c].alias(c) for c in carried], *added)


def _columns(found: list[tuple[np.ndarray, float]]) -> list[pa.Array]:
    counts = [len(ids) for ids, _ in found]
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, dtype=np.int32), *[ids for ids, _ in found]])
    return [
        pa.array(counts, pa.int64()), pa.array([s for _, s in found], pa.float64()),
        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())),
    ]


def decode_documents(encoded: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``encoded`` with the texts of its ``ids``: what was encoded, exactly. No shuffle; null ids give empty texts."""
    bounded_batches(encoded.sparkSession)
    kept = [c for c in encoded.columns if c != text]
    rows = encoded.select(F.struct(*named(kept)).alias("_kept"), F.col("ids").alias("_ids"))
    schema = T.StructType([T.StructField("_kept", rows.schema["_kept"].dataType), T.StructField("_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in batches:
            texts = [decoder.decode(ids.values.to_numpy().tolist() if ids.is_valid else ()) for ids in batch.column("_ids")]
            yield pa.RecordBatch.from_arrays([batch.column("_kept"), pa.array(texts, pa.string())], ["_kept", "_text"])

    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col("_kept")[c].alias(c) for c in kept], F.col("_text").alias(text))
