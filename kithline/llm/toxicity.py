"""Toxicity by compression distance.

Several pairs of zstandard dictionaries are trained from a bounded sample of labelled
rows, each pair on another part of it: one dictionary on ordinary and one on toxic text,
both ending with the same larger dictionary of ordinary text, so that what is common to
all writing costs alike in both. Most of a toxic text is ordinary, so some of the pairs
are trained on mined windows: pairs that have not seen a row tell by how many bytes their
toxic dictionary beats the ordinary one on each of its short windows, the windows where it
does so by most are kept, and new pairs are trained on these, in rounds that keep less and
less. Ordinary rows are mined alike, which teaches the ordinary dictionaries what looks
toxic and is not.

To score a text, it is cut at white space into windows of some WINDOW bytes; each is
compressed with every dictionary, and the bytes by which its toxic dictionaries beat its
ordinary ones are summed over the pairs, which evens out what one trainer's choice of
segments does by chance. Windows are counted over several thresholds, and a logistic
regression fitted on sample rows that no dictionary has seen turns these counts into a
probability. It weighs them by the text's kind of writing too (a few components of its
byte frequencies), as kinds of writing compress differently.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import binary_rows

#: The labelled rows that training takes at most: those of the least hash, and none whose text has over TEXT_BYTES.
TOXIC_ROWS, ORDINARY_ROWS, TEXT_BYTES = 2000, 3000, 32 << 10
WINDOW = 40
#: Pairs trained on mined and on all windows, and the bytes of a dictionary's own part and of the ordinary part that a pair shares.
MINED_PAIRS, WHOLE_PAIRS, OWN_BYTES, BASE_BYTES = 2, 2, 4 << 10, 16 << 10
#: Bytes of a window that is mined, the parts of the rows by which pairs take turns in mining, and the share of each toxic and ordinary row kept by round.
MINE_WINDOW, FOLDS, ROUNDS = 12, 5, ((0.5, 0.5), (0.3, 0.3), (0.15, 0.1))
#: Thresholds of the bytes saved, summed over all pairs.
SAVED, LOST = (1, 2, 3, 4, 6, 8, 10, 12), (1, 2, 4)
#: A dictionary is trained on at most so many windows (about 1 MB), from all rows: those of the least checksum of their row up to their end.
PIECES = 40000
PAD = 48
#: How many components of byte frequencies stand for the kind of writing.
KINDS = 3
RIDGE = 3.0
CUTOFF = 0.3
STEP_BYTES = 1 << 20
_SEP = np.zeros(256, bool)
_SEP[list(b" \t\n\r\x0b\x0c")] = True
#: Fixed value: the repeat offsets that end a trained dictionary's header; its content follows.
_HEADER_END = bytes.fromhex("010000000400000008000000")


def _frequencies(rows: list[np.ndarray]) -> np.ndarray:
    """Square roots of each text's byte frequencies, case folded."""
    h = np.stack([np.bincount(r, minlength=256) / len(r) for r in rows])
    h[:, 97:123] += h[:, 65:91]
    h[:, 65:91] = 0
    return np.sqrt(h)


def _windows(b: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Where the windows of one text start; its end is not among them."""
    seps = np.flatnonzero(_SEP[b])
    at = np.searchsorted(seps, np.arange(size, len(b), size))
    cuts = np.unique(seps[at[at < len(seps)]])
    return np.concatenate([[0], cuts])


class _Sample:
    """Training rows of one kind of text, lower-cased, and the windows (start, end) that dictionaries are trained on."""

    def __init__(self, texts: list[bytes], windows: list[np.ndarray], size: int) -> None:
        self.texts, self.windows, self.size = texts, windows, size

    @classmethod
    def cut(cls, texts: list[bytes], size: int = WINDOW) -> _Sample:
        starts = ((_windows(np.frombuffer(t, np.uint8), size), len(t)) for t in texts)
        return cls(texts, [np.stack([s, np.append(s[1:], n)], axis=1).astype(np.int32) for s, n in starts], size)

    def fold(self, fold: int, folds: int) -> list[int]:
        return list(range(fold, len(self.texts), folds))

    def without(self, fold: int, folds: int) -> _Sample:
        """All rows but one fold's, or all if no others are left."""
        rows = [i for i in range(len(self.texts)) if i % folds != fold] or range(len(self.texts))
        return _Sample([self.texts[i] for i in rows], [self.windows[i] for i in rows], self.size)

    def best(self, saved: list[np.ndarray], share: float) -> _Sample:
        """The share of each row's windows that were saved most, one at least; none that was not saved anything."""
        kept = []
        for w, s in zip(self.windows, saved, strict=True):
            most = np.argsort(-s, kind="stable")[: max(1, round(len(s) * share))]
            kept.append(w[np.sort(most[s[most] > 0])])
        return _Sample(self.texts, kept, self.size)

    def pieces(self) -> list[bytes]:
        """All windows or, beyond PIECES of WINDOW bytes or as many bytes of others, a sample of these."""

        def checked() -> Iterator[tuple[int, bytes]]:
            for t, windows in zip(self.texts, self.windows, strict=True):
                sum_so_far = 0
                for a, b in windows.tolist():
                    sum_so_far = crc32(t[a:b], sum_so_far)
                    yield sum_so_far, t[a:b]

        return [p for _, p in nsmallest(PIECES * WINDOW // self.size, checked())]


class ToxicityModel:
    """The dictionaries' contents by pair, the kinds' mean and axes and the regression's weights; about 170 kilobytes."""

    def __init__(self, pairs: list[tuple[bytes, bytes]], weights: np.ndarray, prior: float) -> None:
        self.pairs, self.weights, self.prior = pairs, weights, prior
        self.middle, self.axes = np.zeros(256), np.zeros((256, KINDS))
        self._made: list | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def _compressors(self) -> list:
        if self._made is None:
            import zstandard as z

            params = z.ZstdCompressionParameters(
                window_log=17, chain_log=15, hash_log=15, search_log=3, min_match=4, strategy=z.STRATEGY_GREEDY,
                write_content_size=0, write_checksum=0, write_dict_id=0,
            )

            def compressor(content: bytes):
                d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                return z.ZstdCompressor(compression_params=params, dict_data=d)

            self._made = [tuple(map(compressor, pair)) for pair in self.pairs]
        return self._made

    def saved(self, data: bytes, segments: np.ndarray) -> np.ndarray:
        """Bytes that the toxic dictionaries save over the ordinary ones on each of the segments (offset, length) that data consists of."""
        import zstandard as z

        # blanks behind each window keep zstandard from storing short ones as they are
        n = segments[:, 1].astype(np.int64)
        buffer = np.full(int(n.sum()) + PAD * len(n), 32, np.uint8)
        shift = np.repeat(np.arange(len(n)) * PAD, n)
        buffer[np.arange(len(shift)) + shift] = np.frombuffer(data, np.uint8)
        padded = np.stack([segments[:, 0].astype(np.int64) + np.arange(len(n)) * PAD, n + PAD], axis=1).astype(np.uint64)
        raw, at, total = buffer.tobytes(), padded.tobytes(), np.zeros(len(n), np.int64)
        for pair in self._compressors():
            for sign, c in zip((1, -1), pair, strict=True):
                out = c.multi_compress_to_buffer(z.BufferWithSegments(raw, at), threads=0)
                total += sign * np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out))
        return total

    def features(self, rows: list[np.ndarray]) -> np.ndarray:
        """A row of counts for each text, which must not be empty."""
        data, segments, owner, base = [], [], [], 0
        for i, r in enumerate(rows):
            starts = _windows(r)
            segments.append(np.stack([starts + base, np.diff(np.append(starts, len(r)))], axis=1))
            owner.append(np.full(len(starts), i))
            data.append(r)
            base += len(r)
        saved = self.saved(np.concatenate(data).tobytes().lower(), np.concatenate(segments).astype(np.uint64))
        own, n = np.concatenate(owner), len(rows)
        windows, pairs = np.bincount(own, minlength=n), len(self.pairs)
        counts = np.stack([np.bincount(own, saved >= k, minlength=n) for k in SAVED], axis=1)
        lost = np.stack([np.bincount(own, saved <= -k, minlength=n) for k in LOST], axis=1)
        most = np.full(n, -99)
        np.maximum.at(most, own, saved)
        mean = np.bincount(own, np.clip(saved, -4 * pairs, 4 * pairs), minlength=n) / windows
        x = np.column_stack([np.log(windows), np.log1p(counts), counts / windows[:, None], lost / windows[:, None], np.clip(most, -4, 12 * pairs), mean])
        kind = (_frequencies(rows) - self.middle) @ self.axes
        return np.column_stack([x, kind, *(x * k[:, None] for k in kind.T)])

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        if len(self.weights) == 0:
            return np.full(len(rows), self.prior)
        x = np.column_stack([np.ones(len(rows)), self.features(rows)])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))

    @classmethod
    def train(cls, toxic: list[bytes], ordinary: list[bytes], rate: float) -> ToxicityModel:
        """rate: the share of toxic rows among all labelled ones, which scores are calibrated to."""
        held = lambda rows: ([r for i, r in enumerate(rows) if i % 3], rows[::3])
        (toxic_own, toxic_cal), (plain_own, plain_cal) = held(toxic), held(ordinary)
        if not toxic_own or not plain_own:
            return cls([], np.empty(0), rate)
        plain_rows, toxic_rows = ([r.lower() for r in rows] for rows in (plain_own, toxic_own))
        plain_whole, toxic_whole = _Sample.cut(plain_rows), _Sample.cut(toxic_rows)
        plain_mined, toxic_mined = cls._mined(plain_whole, toxic_whole, rate)
        bases = cls._bases(plain_whole, MINED_PAIRS)
        pairs = cls._pairs(plain_mined, toxic_mined, bases) + cls._pairs(plain_whole, toxic_whole, bases)[:WHOLE_PAIRS]
        model = cls(pairs, np.empty(0), rate)
        seen_rows = _frequencies([np.frombuffer(t, np.uint8) for t in (*toxic_own, *plain_own)])
        model.middle = seen_rows.mean(axis=0)
        values, vectors = np.linalg.eigh(np.cov(seen_rows.T, bias=True))
        model.axes = vectors[:, np.argsort(-values)[:KINDS]] * 10
        texts = [np.frombuffer(t, np.uint8) for t in (*toxic_cal, *plain_cal)]
        y = np.array([1.0] * len(toxic_cal) + [0.0] * len(plain_cal))
        weight = np.where(y == 1, rate / max(1, len(toxic_cal)), (1 - rate) / max(1, len(plain_cal))) * len(y)
        model.weights = _regression(model.features(texts), y, weight)
        return model

    @classmethod
    def _mined(cls, plain: _Sample, toxic: _Sample, rate: float) -> tuple[_Sample, _Sample]:
        """The short windows of both kinds of rows that look most toxic to pairs that have not seen the row."""
        bases = cls._bases(plain, FOLDS)
        every = plain, toxic = [_Sample.cut(s.texts, MINE_WINDOW) for s in (plain, toxic)]
        for shares in ROUNDS:
            models = [cls([pair], np.empty(0), rate) for pair in cls._pairs(plain, toxic, bases)]
            toxic, plain = (s.best(cls._savings(models, s), share) for s, share in zip(reversed(every), shares, strict=True))
        return plain, toxic

    @staticmethod
    def _savings(models: list[ToxicityModel], sample: _Sample) -> list[np.ndarray]:
        """What each window of the sample's rows saves with the model that has not seen the row; the windows make up whole texts."""
        saved: list = [None] * len(sample.texts)
        for fold, model in enumerate(models):
            rows = sample.fold(fold, len(models))
            ends = np.cumsum([len(sample.texts[i]) for i in rows])
            for step in np.split(np.array(rows, int), np.flatnonzero(np.diff(ends // STEP_BYTES)) + 1):
                if len(step):
                    data = b"".join(sample.texts[i] for i in step)
                    n = np.concatenate([sample.windows[i][:, 1] - sample.windows[i][:, 0] for i in step]).astype(np.int64)
                    got = model.saved(data, np.stack([np.cumsum(n) - n, n], axis=1).astype(np.uint64))
                    for i, part in zip(step, np.split(got, np.cumsum([len(sample.windows[i]) for i in step])[:-1]), strict=True):
                        saved[i] = part
        return saved

    @classmethod
    def _bases(cls, plain: _Sample, n: int) -> list[bytes]:
        return [cls._dictionary(plain.without(p, n), BASE_BYTES) for p in range(n)]

    @classmethod
    def _pairs(cls, plain: _Sample, toxic: _Sample, bases: list[bytes]) -> list[tuple[bytes, bytes]]:
        """A pair of dictionaries for each base; each row is left out of one pair, unless there are too few to leave any out."""
        part = lambda s, p: cls._dictionary(s.without(p, len(bases)), OWN_BYTES)
        return [(part(plain, p) + base, part(toxic, p) + base) for p, base in enumerate(bases)]

    @classmethod
    def _trained(cls, texts: list[bytes], sizes: tuple[int, ...] = (OWN_BYTES,)) -> list[bytes]:
        """The contents of dictionaries trained on all windows of the texts or, beyond PIECES, on a sample of these."""
        return [cls._dictionary(_Sample.cut(texts), size) for size in sizes]

    @staticmethod
    def _dictionary(sample: _Sample, size: int) -> bytes:
        import zstandard as z

        pieces = sample.pieces()
        try:
            trained = z.train_dictionary(size, pieces, k=12, d=8).as_bytes() if pieces else b""
        except z.ZstdError:  # too few samples to choose from
            return b" ".join(pieces)[:size]
        return trained[trained.find(_HEADER_END) + len(_HEADER_END) :] if trained else b""


def _regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the intercept comes first."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w, penalty = np.zeros(z.shape[1]), np.r_[1e-6, np.full(x.shape[1], ridge)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (y - p)) - penalty * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    own = w[1:] / scale
    return np.r_[w[0] - (own * mean).sum(), own]


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> ToxicityModel:
    """Trains on rows of docs (doc_id, text) that labels (doc_id, toxic) marks.

    At most toxic_rows and ordinary_rows of them, by the hash of their id, come to the driver,
    with whole texts; of these, texts of over TEXT_BYTES are left out, which bounds the sample. Ids that are labelled twice are toxic if any label says so; null
    labels, ids and texts are left out. Without rows of both kinds every score is the
    share of toxic labels (0 without labels).
    """
    marked = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    n = {bool(r[0]): r[1] for r in marked.groupBy(F.col("_toxic") > 0).count().collect()}
    rate = n.get(True, 0) / max(1, sum(n.values()))
    ordered = marked.orderBy(F.xxhash64("_id"), "_id")
    picked = ordered.where("_toxic > 0").limit(toxic_rows).union(ordered.where("_toxic <= 0").limit(ordinary_rows))
    texts = docs.where(F.octet_length("text") <= TEXT_BYTES).select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("text"))
    got = texts.join(F.broadcast(picked), "_id").groupBy("_id").agg(F.max("_toxic").alias("_toxic"), F.min("text").alias("text"))
    kinds: dict[bool, list[bytes]] = {True: [], False: []}
    for _, toxic, text in sorted(got.select("_id", "_toxic", "text").toLocalIterator(), key=lambda r: r[0]):
        if len(text):
            kinds[toxic > 0].append(bytes(text))
    return ToxicityModel.train(kinds[True], kinds[False], rate)


def _scored(column, model: ToxicityModel) -> Iterator[float]:
    def flush(rows: list[np.ndarray | None]) -> Iterator[float]:
        full = [r for r in rows if r is not None and len(r)]
        found = iter(model.scores(full).tolist() if full else [])
        for r in rows:
            yield next(found) if r is not None and len(r) else 0.0

    rows, size = [], 0
    for r in binary_rows(column):
        rows.append(r)
        size += 0 if r is None else len(r)
        if size >= STEP_BYTES:
            yield from flush(rows)
            rows, size = [], 0
    yield from flush(rows)


def score(docs: DataFrame, model: ToxicityModel, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, score and predicted for each row of docs (doc_id, text); null and empty texts score 0.

    Repeated rows and null ids are scored like others; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            s = np.fromiter(_scored(b.column(1), sent.value), np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= cutoff).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, score double, predicted int")


def ordinary(docs: DataFrame, model: ToxicityModel, cutoff: float = CUTOFF) -> DataFrame:
    """docs without the rows that score cutoff or more; all columns stay, whatever their names.

    Null and empty texts score 0 and stay. Repeated rows and null ids are judged each by their
    text. An empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.large_binary())
            yield b.filter(pa.array([s < cutoff for s in _scored(texts, sent.value)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity, learnt from the labels of rows that are not held out."""
    docs, labels = (common.text_sources(spark, sf_dir, t) for t in ("documents", "labels"))
    model = fit(docs, labels.where(~common.held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
