"""Pair scorers over a bit-parallel longest common subsequence, a batch of pairs at a time.

ratio is the normalised insertion-deletion similarity 100 * 2 * LCS / (m + n). The
token scorers apply it to sorted tokens; partial_ratio to the best window of the
longer text. The functions of one pair define the scores; the UDFs compute the same
for whole Arrow batches, one 64-bit word operation for all pairs and a character of
each at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word operation per character of b and 64 of a."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs(a, b) / total if total else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not only_x or not only_y):
        return 100.0
    with_x, with_y = (f"{both} {o}".strip() for o in (only_x, only_y))
    best = ratio(with_x, with_y)
    return max(best, ratio(both, with_x), ratio(both, with_y)) if both else best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with any window of the longer one of its length, clipped ends included."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0

    def best(short: str, long: str) -> float:
        n, m, out, known = len(short), len(long), 0.0, set(short)
        for end in range(1, m + n):
            lo, hi = max(0, end - n), min(m, end)
            # a window whose outer character is not in the short text cannot beat its neighbour
            if (hi == end and long[hi - 1] in known) or (hi < end and long[lo] in known):
                out = max(out, ratio(short, long[lo:hi]))
                if out == 100.0:
                    break
        return out

    return best(a, b) if len(a) < len(b) else best(b, a) if len(a) > len(b) else max(best(a, b), best(b, a))


def jaro_winkler(a: str, b: str) -> float:
    """Similarity from 0 to 1; the common prefix (up to 4) counts where Jaro is above 0.7."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, mine = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                mine.append(ch)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [ch for ch, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


#: Compared characters (pairs times length) or window steps that are held at once.
HELD = 1 << 21
#: Fillers behind the shorter texts of a batch, which equal no character and not each other.
_FILL_A, _FILL_B = 0xFFFFFFFE, 0xFFFFFFFF


def _matrix(texts: list[str], width: int, fill: int) -> np.ndarray:
    """Code points of the texts, a row each, filled up to width."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), width), fill, np.uint32)
    out[np.arange(width) < n[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def _bits(equal: np.ndarray) -> np.ndarray:
    """Booleans, a multiple of 64 in the last axis, as 64-bit words."""
    return np.packbits(equal, axis=-1, bitorder="little").view("<u8")


def lcs_batch(a: list[str], b: list[str]) -> np.ndarray:
    """lcs of each pair."""
    out = np.zeros(len(a), np.int64)
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b, strict=True)]
    long = [y if len(x) <= len(y) else x for x, y in zip(a, b, strict=True)]
    m, n = (np.fromiter(map(len, t), np.int64, len(t)) for t in (short, long))
    words = -(-m // 64)
    order = np.lexsort((n, words))
    order = order[m[order] > 0]
    at = 0
    while at < len(order):
        w = int(words[order[at]])
        end = min(at + max(1, HELD // (64 * w)), int(np.searchsorted(words[order], w, side="right")))
        own = order[at:end]
        at = end
        x = _matrix([short[i] for i in own], 64 * w, _FILL_A)
        y = _matrix([long[i] for i in own], int(n[own].max()), _FILL_B)
        row = np.full((w, len(own)), np.uint64(2**64 - 1))
        for j in range(y.shape[1]):
            masks, carry = _bits(x == y[:, j, None]), np.zeros(len(own), np.uint64)
            for k in range(w):
                hit = row[k] & masks[:, k]
                total = row[k] + hit
                over = total < hit
                total += carry
                carry = (over | (total < carry)).astype(np.uint64)
                row[k] = total | (row[k] - hit)
        out[own] = 64 * w - np.bitwise_count(row).sum(axis=0, dtype=np.int64)
    return out


def ratio_batch(a: list[str], b: list[str]) -> np.ndarray:
    total = np.fromiter(map(len, a), np.int64, len(a)) + np.fromiter(map(len, b), np.int64, len(b))
    return np.where(total > 0, 200.0 * lcs_batch(a, b) / np.maximum(total, 1), 100.0)


def _each(f: Callable, texts: list[str]) -> list:
    """f of each text, computed once for each distinct one."""
    known = {t: f(t) for t in set(texts)}
    return [known[t] for t in texts]


def token_sort_ratio_batch(a: list[str], b: list[str]) -> np.ndarray:
    sort = lambda t: " ".join(sorted(t.split()))
    return ratio_batch(_each(sort, a), _each(sort, b))


def token_set_ratio_batch(a: list[str], b: list[str]) -> np.ndarray:
    out, rest = np.zeros(len(a)), []
    words = lambda t: frozenset(t.split())
    for i, (x, y) in enumerate(zip(_each(words, a), _each(words, b), strict=True)):
        if not x or not y:
            continue
        both, only_x, only_y = x & y, x - y, y - x
        if both and (not only_x or not only_y):
            out[i] = 100.0
            continue
        same = " ".join(sorted(both))
        rest.append((i, len(same), *(f"{same} {' '.join(sorted(o))}".strip() for o in (only_x, only_y))))
    if rest:
        at, same, with_x, with_y = zip(*rest, strict=True)
        best, n = ratio_batch(list(with_x), list(with_y)), np.array(same)
        for side in (with_x, with_y):  # the common words are the beginning of either side
            best = np.where(n > 0, np.maximum(best, 200.0 * n / (n + np.fromiter(map(len, side), np.int64, len(side)))), best)
        out[list(at)] = best
    return out


def _best_window(short: list[str], long: list[str]) -> np.ndarray:
    """The best ratio of each short text (1 to 64 characters) with any window of the long one."""
    n, m = (np.fromiter(map(len, t), np.int64, len(t)) for t in (short, long))
    x, y = _matrix(short, 64, _FILL_A), _matrix(long, int(m.max()), _FILL_B)
    masks = np.stack([_bits(x == y[:, j, None])[:, 0] for j in range(y.shape[1])], axis=1)
    pair = np.repeat(np.arange(len(m)), m)  # a run over the long text from each of its positions on
    start = np.arange(len(pair)) - np.repeat(np.cumsum(m) - m, m)
    steps = np.minimum(n[pair], m[pair] - start)
    order = np.argsort(-steps, kind="stable")
    pair, start, steps = pair[order], start[order], steps[order]
    active = np.searchsorted(-steps, -np.arange(int(steps.max())), side="left")
    row, best = np.full(len(pair), np.uint64(2**64 - 1)), np.zeros(len(m))
    for t in range(len(active)):
        k = active[t]
        own = row[:k]
        hit = own & masks[pair[:k], start[:k] + t]
        row[:k] = (own + hit) | (own - hit)
        # a window ends here if the run does or if it began with the text
        ends = np.flatnonzero((steps[:k] == t + 1) | (start[:k] == 0))
        common = 64 - np.bitwise_count(row[ends]).astype(np.int64)
        np.maximum.at(best, pair[ends], 200.0 * common / (n[pair[ends]] + t + 1))
    return best


def partial_ratio_batch(a: list[str], b: list[str]) -> np.ndarray:
    out = np.array([100.0 if not x and not y else 0.0 for x, y in zip(a, b, strict=True)])
    todo: list[tuple[int, str, str]] = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x and y:
            if x == y:
                out[i] = 100.0
            elif min(len(x), len(y)) > 64:
                out[i] = partial_ratio(x, y)
            else:
                todo += [(i, *sorted((x, y), key=len))] if len(x) != len(y) else [(i, x, y), (i, y, x)]
    todo.sort(key=lambda p: len(p[2]))
    at = 0
    while at < len(todo):
        end, held = at, 0
        while end < len(todo) and (end == at or held + len(todo[end][2]) * 64 <= HELD):
            held += len(todo[end][2]) * 64
            end += 1
        index, short, long = zip(*todo[at:end], strict=True)
        np.maximum.at(out, list(index), _best_window(list(short), list(long)))
        at = end
    return out


def jaro_winkler_batch(a: list[str], b: list[str]) -> np.ndarray:
    return np.array(_each(lambda p: jaro_winkler(*p), list(zip(a, b, strict=True))), float)


SCORERS = {f.__name__: f for f in (ratio, token_set_ratio, token_sort_ratio, partial_ratio, jaro_winkler)}
BATCHES = {f.__name__.removesuffix("_batch"): f for f in (ratio_batch, token_set_ratio_batch, token_sort_ratio_batch, partial_ratio_batch, jaro_winkler_batch)}


def scored(name: str, a: list[str | None], b: list[str | None]) -> np.ndarray:
    """The scores of all pairs, NaN where either side is None."""
    known = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and y is not None]
    out = np.full(len(a), np.nan)
    if known:
        out[known] = BATCHES[name]([a[i] for i in known], [b[i] for i in known])
    return out


_columns: dict[str, Callable] = {}


def scorer(name: str) -> Callable[[Column, Column], Column]:
    """The Arrow UDF of a scorer by name; null if either side is."""
    if name not in _columns:
        import pandas as pd

        def score(a, b):  # noqa: ANN001, ANN202
            return pd.Series(scored(name, a.tolist(), b.tolist())).astype(object).where(lambda s: s.notna(), None)

        # pandas_udf reads the hints, so they must be objects
        score.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
        _columns[name] = F.pandas_udf(score, "double")
    return _columns[name]


#: Feature, text column and scorer.
PAIR_SCORES = (
    ("name_ratio", "name_n", "ratio"), ("name_tset", "name_n", "token_set_ratio"), ("name_tsort", "name_n", "token_sort_ratio"),
    ("name_partial", "name_n", "partial_ratio"), ("core_ratio", "name_core", "ratio"), ("core_tset", "name_core", "token_set_ratio"),
    ("core_jw", "name_core", "jaro_winkler"), ("sq_ratio", "name_sq", "ratio"), ("sq_partial", "name_sq", "partial_ratio"),
    ("addr_ratio", "addr_n", "ratio"), ("addr_tset", "addr_n", "token_set_ratio"), ("addr_tsort", "addr_n", "token_sort_ratio"),
    ("addr_partial", "addr_n", "partial_ratio"), ("nums_tset", "nums", "token_set_ratio"), ("nums_ratio", "nums", "ratio"),
)
#: Text columns the pair scores read, and the score of a record's alias with the other name.
SCORED_TEXT = tuple(dict.fromkeys(c for _, c, _ in PAIR_SCORES))
ALIAS_SCORE = ("alt_tset", "name_alt", "name_n", "token_set_ratio")


def all_scores() -> Column:
    """One struct of all PAIR_SCORES and alt_tset (null without an alias) over columns q_* and s1_*; each batch crosses to Python once."""
    import pandas as pd

    names = [f"{side}_{c}" for side in ("q", "s1") for c in SCORED_TEXT]

    def score(*columns):  # noqa: ANN002, ANN202
        text = dict(zip([*names, "q_name_alt"], (c.tolist() for c in columns), strict=True))
        out = {f: scored(s, text[f"q_{c}"], text[f"s1_{c}"]) for f, c, s in PAIR_SCORES}
        feature, alias, name, how = ALIAS_SCORE
        out[feature] = scored(how, [x or None for x in text[f"q_{alias}"]], text[f"s1_{name}"])
        return pd.DataFrame({k: pd.Series(v).astype(object).where(~np.isnan(v), None) for k, v in out.items()})

    score.__annotations__ = {"columns": pd.Series, "return": pd.DataFrame}
    schema = ", ".join(f"{f} double" for f in [*(f for f, _, _ in PAIR_SCORES), ALIAS_SCORE[0]])
    return F.pandas_udf(score, schema)(*[F.col(c) for c in [*names, "q_name_alt"]])
