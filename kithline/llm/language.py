"""Language identification: script ranges, word scores, Viterbi with a switching penalty.

Model: for each language smoothed log frequencies of hashed byte n-grams of its
words, learnt from a bounded sample of labelled rows, and the scripts its words
are written in. A text's words (runs of letters) get a score in each language
whose script fits, relative to the best; Viterbi then finds the labelling of
all words with the least total cost, where each change of language costs
SWITCH_PENALTY. Equal labels in a row form a span. Everything runs on whole texts,
in arrays over all words of a batch; each distinct word is scored once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .shingles import WordHasher, binary_rows, mix

#: Labelled rows a language is learnt from at most, none of them of over TEXT_BYTES.
ROWS_PER_LANGUAGE, TEXT_BYTES = 400, 64 << 10
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
SWITCH_PENALTY = 8.0
#: Largest cost of one word, so that a single odd word does not outweigh its surroundings.
WORD_LIMIT = 6.0
MIN_SHARE = 0.02
#: Bytes of text that are gathered before they are labelled, and costs (words times languages) that are held at once.
STEP_BYTES, STEP_COSTS = 1 << 21, 1 << 22
#: New words that are scored at once; each takes about a kilobyte meanwhile.
SCORED_WORDS = 8192
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalpha())
#: First code points of Unicode script ranges, and the script from there on.
SCRIPT_RANGES = (
    (0x41, "latin"), (0x2B0, "other"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"),
    (0x600, "arabic"), (0x780, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"), (0xFB00, "other"),
)
SCRIPTS = tuple(dict.fromkeys(name for _, name in SCRIPT_RANGES))


def script_of(words: list[bytes]) -> np.ndarray:
    """The script of each word: that of its first character beyond ASCII, else Latin."""
    from bisect import bisect_right

    starts, names = [a for a, _ in SCRIPT_RANGES], [SCRIPTS.index(n) for _, n in SCRIPT_RANGES]
    latin = SCRIPTS.index("latin")
    out = np.full(len(words), latin, np.int8)
    for i, w in enumerate(words):
        if not w.isascii():
            c = next(ord(c) for c in w.decode("utf-8", "replace") if c > "\x7f")
            out[i] = names[bisect_right(starts, c) - 1] if c >= 0xC0 else latin
    return out


class Words:
    """The words of a text as hashes, with positions in its bytes."""

    def __init__(self) -> None:
        self.hasher = WordHasher(SEPARATORS)

    def of(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = ~self.hasher.is_sep[b]
        edge = np.diff(inside)
        return self.hasher.words(b), np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words (padded, A-Z folded), and the word each belongs to."""
    padded = [b"\x02" + w.lower() + b"\x03" for w in words]
    b = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint64)
    length = np.array([len(p) for p in padded])
    owner = np.repeat(np.arange(len(words)), length)
    buckets, owners, h = [], [], np.zeros(len(b), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        # h[i] covers n bytes from i on
        h = mix(h[: len(b) - n + 1] * np.uint64(0x100000001B3) + b[n - 1 :] + np.uint64(n))
        if n in ORDERS:
            whole = owner[: len(b) - n + 1] == owner[n - 1 :]
            buckets.append((h[whole] % np.uint64(BUCKETS)).astype(np.int64))
            owners.append(owner[: len(b) - n + 1][whole])
    return np.concatenate(buckets), np.concatenate(owners)


class LanguageModel:
    """langs, log frequencies (bucket, language) and allowed (script, language)."""

    def __init__(self, langs: list[str], logs: np.ndarray, allowed: np.ndarray) -> None:
        self.langs, self.logs, self.allowed = langs, logs, allowed

    @classmethod
    def learn(cls, samples: dict[str, list[bytes]]) -> LanguageModel:
        langs = sorted(samples)
        counts, scripts, split = np.full((BUCKETS, len(langs)), 0.5), np.zeros((len(SCRIPTS), len(langs))), Words()
        for j, lang in enumerate(langs):
            for text in samples[lang]:
                _, start, end = split.of(np.frombuffer(text, np.uint8))
                words = [text[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
                if words:
                    counts[:, j] += np.bincount(_ngrams(words)[0], minlength=BUCKETS)
                    scripts[:, j] += np.bincount(script_of(words), minlength=len(SCRIPTS))
        logs = np.log(counts / counts.sum(axis=0))
        share = scripts / np.maximum(scripts.sum(axis=0), 1)
        return cls(langs, logs.astype(np.float32), share >= MIN_SHARE)

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Cost of each word in each language: 0 in the best, at most WORD_LIMIT."""
        return np.concatenate([self._scores(words[i : i + SCORED_WORDS]) for i in range(0, len(words), SCORED_WORDS)])

    def _scores(self, words: list[bytes]) -> np.ndarray:
        bucket, owner = _ngrams(words)
        sums = np.empty((len(words), len(self.langs)), np.float32)
        for j in range(len(self.langs)):
            sums[:, j] = np.bincount(owner, self.logs[bucket, j], minlength=len(words))
        fits = self.allowed[script_of(words)]
        fits[~fits.any(axis=1)] = True  # a script no language is known in says nothing
        sums[~fits] = -np.inf
        return np.minimum(sums.max(axis=1, keepdims=True) - sums, WORD_LIMIT)


class Labeller:
    """Labels the words of texts; remembers the scores of words it has met, up to a bound.

    Words and costs are held for blocks of words, so memory is bounded however long a text
    is and however many languages there are. What is remembered is a few sorted runs, each
    at least twice as long as the next, so a new word is sorted in a logarithm of times.
    """

    def __init__(self, model: LanguageModel, penalty: float = SWITCH_PENALTY, remember: int = 4_000_000, step_costs: int = STEP_COSTS) -> None:
        self.model, self.penalty, self.split = model, penalty, Words()
        langs = max(1, len(model.langs))
        self.remember, self.block = max(1, remember // langs), max(2, step_costs // langs)
        self.forget()

    def forget(self) -> None:
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def _remember(self, words: np.ndarray, costs: np.ndarray) -> None:
        if sum(len(r[0]) for r in self.runs) > self.remember:
            self.forget()
        while self.runs and len(self.runs[-1][0]) < 2 * len(words):
            more, theirs = self.runs.pop()
            words, costs = np.concatenate([more, words]), np.concatenate([theirs, costs])
            order = np.argsort(words, kind="stable")
            words, costs = words[order], costs[order]
        self.runs.append((words, costs))

    def cost(self, h: np.ndarray, start: np.ndarray, end: np.ndarray, data: bytes) -> np.ndarray:
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        out, new = np.empty((len(distinct), len(self.model.langs)), np.float32), np.ones(len(distinct), bool)
        for known, costs in self.runs:
            at = np.searchsorted(known, distinct)
            at[at == len(known)] = 0
            met = known[at] == distinct
            out[met] = costs[at[met]]
            new &= ~met
        if new.any():
            pos = first[new]
            out[new] = self.model.scores([data[s:e] for s, e in zip(start[pos].tolist(), end[pos].tolist(), strict=True)])
            self._remember(distinct[new], out[new])
        return out[back]

    def forward(self, cost: np.ndarray, bounds: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Least cost of ending in each language at the end of each text, and how it came about for each word.

        Words bounds[i]:bounds[i + 1] are those of text i. state is the cost before the first
        word, if a text went on before it; only one text is given then. Returns the states
        (in the order of the texts), and for each word which languages were held on to and
        which one the others came from (not set for first words without a state).
        """
        length = np.diff(bounds)
        order = np.argsort(-length, kind="stable")
        starts, lengths = bounds[:-1][order], length[order]
        longest = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts with over t words
        now = np.zeros((len(lengths), cost.shape[1]), np.float32) if state is None else state.copy()
        stay = np.ones(cost.shape, bool)
        origin = np.zeros(len(cost), np.int32)
        for t in range(longest):
            k = active[t]
            at = starts[:k] + t
            s = now[:k]
            if t or state is not None:
                best = s.argmin(axis=1)
                switch = s[np.arange(k), best] + np.float32(self.penalty)
                keep = s <= switch[:, None]
                stay[at], origin[at] = keep, best
                s = np.where(keep, s, switch[:, None])
            s = s + cost[at]
            now[:k] = s - s.min(axis=1, keepdims=True)
        ends = np.empty_like(now)
        ends[order] = now
        return ends, stay, origin

    @staticmethod
    def backward(last: np.ndarray, stay: np.ndarray, origin: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Labels of all words, given those of the texts' last words, and the labels before the first words."""
        length = np.diff(bounds)
        order = np.argsort(-length, kind="stable")
        starts, lengths = bounds[:-1][order], length[order]
        longest = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")
        label, now = np.empty(len(origin), np.int32), last[order].astype(np.int32)
        for t in range(longest - 1, -1, -1):
            k = active[t]
            at = starts[:k] + t
            label[at] = now[:k]
            now[:k] = np.where(stay[at, now[:k]], now[:k], origin[at])
        before = np.empty_like(now)
        before[order] = now
        return label, before

    def viterbi(self, cost: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Labels of all words; words bounds[i]:bounds[i + 1] are those of text i."""
        ends, stay, origin = self.forward(cost, bounds)
        return self.backward(ends.argmin(axis=1), stay, origin, bounds)[0]

    def long_text(self, words: tuple[np.ndarray, np.ndarray, np.ndarray], data: bytes) -> np.ndarray:
        """Labels of one text of any length: forward by blocks, keeping each block's first state, then back, each block anew."""
        h, start, end = words
        cuts = list(range(0, len(h), self.block))
        piece = lambda a: self.cost(h[a : a + self.block], start[a : a + self.block], end[a : a + self.block], data)
        states: list[np.ndarray | None] = [None]
        for a in cuts:
            cost = piece(a)
            states.append(self.forward(cost, np.array([0, len(cost)]), states[-1])[0])
        label, last = np.empty(len(h), np.int32), states[-1].argmin(axis=1)
        for i in range(len(cuts) - 1, -1, -1):
            cost = piece(cuts[i])
            bounds = np.array([0, len(cost)])
            _, stay, origin = self.forward(cost, bounds, states[i])
            label[cuts[i] : cuts[i] + len(cost)], last = self.backward(last, stay, origin, bounds)
        return label

    def __call__(self, rows: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its words' labels, starts and ends in bytes."""
        out, held, size = [None] * len(rows), [], 0

        def flush() -> None:
            parts = [p for _, p in held]
            bounds = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int64)
            shift = np.concatenate([[0], np.cumsum([len(rows[i]) for i, _ in held])])
            h, start, end = (np.concatenate([p[c] + (shift[k] if c else np.uint64(0)) for k, p in enumerate(parts)]) for c in range(3))
            label = self.viterbi(self.cost(h, start, end, np.concatenate([rows[i] for i, _ in held]).tobytes()), bounds)
            for (i, p), a, b in zip(held, bounds[:-1], bounds[1:], strict=True):
                out[i] = (label[a:b], p[1], p[2])

        for i, r in enumerate(rows):
            p = self.split.of(r)
            if not len(p[0]):
                out[i] = (np.empty(0, np.int32), p[1], p[2])
            elif len(p[0]) > self.block:
                out[i] = (self.long_text(p, r.tobytes()), p[1], p[2])
            else:
                if size + len(p[0]) > self.block:
                    flush()
                    held, size = [], 0
                held.append((i, p))
                size += len(p[0])
        if held:
            flush()
        return out


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Learns from rows (doc_id, text, lang) whose text and lang are known.

    At most rows_per_language rows of each language, those of the least hash of their id
    and text, come to the driver; repeated rows count once, and texts of over TEXT_BYTES
    are left out of this sample. Languages are taken to be few (hundreds): the model has
    BUCKETS numbers for each. No row gives a model without languages.
    """
    known = labelled.where((F.octet_length("text") <= TEXT_BYTES) & F.col("lang").isNotNull()).select("lang", F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id", "text").alias("_h"))
    counts = known.groupBy("lang").agg(F.count("*").alias("_all"))  # a row per language
    low = known.join(F.broadcast(counts), "lang").where(common.among_least(F.col("_h"), F.col("_all"), rows_per_language))
    rows = low.groupBy("lang", "_h").agg(F.min("text").alias("text"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_n") <= rows_per_language)
    samples: dict[str, list[bytes]] = {}
    for lang, text in first.select("lang", "text").toLocalIterator():
        samples.setdefault(lang, []).append(bytes(text))
    return LanguageModel.learn(samples)


def _letters(text: np.ndarray) -> bool:
    import regex

    return regex.search(r"\p{L}", text.tobytes().decode("utf-8", "replace")) is not None


def _labelled(column, labeller: Labeller) -> Iterator[tuple]:
    """(lang or None, share, spans) of each row of a binary column."""
    def flush(rows: list[np.ndarray | None]) -> Iterator[tuple]:
        texts = [r for r in rows if r is not None]
        done = iter(labeller(texts) if texts and labeller.model.langs else [])
        for r in rows:
            if r is None or not labeller.model.langs:
                yield None, 0.0, []
                continue
            label, start, end = next(done)
            weight = np.bincount(label, end - start, minlength=len(labeller.model.langs))
            if not len(label) or not _letters(r):
                yield None, 0.0, []
                continue
            cut = np.flatnonzero(np.diff(label)) + 1
            spans = [(labeller.model.langs[label[a]], int(start[a]), int(end[b - 1])) for a, b in zip(np.r_[0, cut], np.r_[cut, len(label)], strict=True)]
            top = int(weight.argmax())
            yield labeller.model.langs[top], float(weight[top] / weight.sum()), spans

    rows, size = [], 0
    for r in binary_rows(column):
        rows.append(r)
        size += 0 if r is None else len(r)
        if size >= STEP_BYTES:
            yield from flush(rows)
            rows, size = [], 0
    yield from flush(rows)


def identify(docs: DataFrame, model: LanguageModel, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """doc_id, lang_pred, score and spans (lang, start and end in UTF-8 bytes) for each row of docs (doc_id, text).

    lang_pred is the language of most letters, score its share of them. Null texts, texts
    without a letter and any text under a model without languages are `und` with score 0
    and no spans. Repeated rows and null ids are labelled like others.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.logs, model.allowed))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        labeller = Labeller(LanguageModel(*sent.value), penalty)
        span = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            lang, score, spans = zip(*_labelled(b.column(1), labeller), strict=True) if b.num_rows else ((), (), ())
            rows = [[{"lang": x[0], "start": x[1], "end": x[2]} for x in s] for s in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x or "und" for x in lang], pa.string()), pa.array(score, pa.float64()), pa.array(rows, span)], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<lang:string,start:long,end:long>>")


def accept(docs: DataFrame, model: LanguageModel, min_score: float = 0.35, langs: tuple[str, ...] | None = None) -> DataFrame:
    """docs without rows that are `und`, under min_score or in a language not in langs (None: any); all columns stay, whatever their names.

    Null, empty and letterless texts are `und` and go, as does every row under a model without
    languages. Repeated rows and null ids are judged each by their text. An empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.logs, model.allowed))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        labeller = Labeller(LanguageModel(*sent.value))
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.large_binary())
            keep = [lang is not None and score >= min_score and (langs is None or lang in langs) for lang, score, _ in _labelled(texts, labeller)][: b.num_rows]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language, learnt from those that are not held out."""
    docs = common.text_sources(spark, sf_dir, "documents")
    model = fit(docs.where(~common.held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
