"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

The field has two states and real-valued line features. It is fitted by gradient ascent on the conditional likelihood of
a bounded sample of labelled documents (their lines bear the document's label), and decoded by Viterbi for all documents of
a batch side by side. A document stays if it passes the base rules and the share of its words on content lines is enough.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import WORD_HASHES, bytes_of, by_size, windows_of

SPACES, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
UPPER, LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
N_FEATURES = 9
BATCH_BYTES = 4 << 20
BOILERPLATE, CONTENT = 0, 1
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Field:
    """Weights: features x states, from state x to state, first state."""

    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray


# ---------------------------------------------------------------------------------------------- one document


def repeated(words: list[bytes], width: int = 3) -> np.ndarray:
    """Which words are inside a window of ``width`` words that the text has twice or more."""
    mark = np.zeros(len(words) + 1, np.int64)
    windows = windows_of(WORD_HASHES.of(words), width)
    if len(windows) > 1:
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        twice = np.zeros(len(windows), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        at = np.flatnonzero(twice)
        np.add.at(mark, at, 1)
        np.add.at(mark, at + width, -1)
    return np.cumsum(mark[:-1]) > 0


def described(text: bytes) -> tuple[tuple[int, ...], np.ndarray, np.ndarray]:
    """Base counts of a text; features and word counts of its lines that have a word."""
    words = text.split()
    mark = repeated(words)
    lines = [(line, n) for line in text.split(b"\n") if (n := len(line.split()))]
    seen: set[bytes] = set()
    rows = []
    for line, n in lines:
        size = len(line)
        letters = size - len(line.translate(None, LETTERS))
        upper = size - len(line.translate(None, UPPER))
        rows.append((
            1.0, n, (size - len(line.translate(None, SYMBOLS))) / n, (line.count(b"!") + line.count(b"?")) / n,
            upper / (letters or 1), (size - len(line.translate(None, b"0123456789"))) / size, line in seen, 0.0,
            letters / (size - line.count(b" ")),
        ))
        seen.add(line)
    features = np.array(rows, np.float64).reshape(-1, N_FEATURES)
    n_words = features[:, 1].astype(np.int64)
    if len(rows):
        features[:, 7] = np.add.reduceat(mark, np.cumsum(n_words) - n_words, dtype=np.int64) / n_words
        features[:, 1] = np.log1p(features[:, 1])
    chars = len(text.decode()) - (len(text) - len(text.translate(None, SPACES)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    base = (len(words), chars, symbols, len(lines) - len(seen), int(mark.sum()))
    return base, features, n_words


# ---------------------------------------------------------------------------------------------- the field


class Sequences:
    """Line sequences of several documents, walked side by side; longer ones first."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        self.order, self.begin = order, (np.cumsum(lengths) - lengths)[order]
        self.sorted = lengths[order]
        self.steps = int(self.sorted[0]) if len(lengths) else 0

    def rows(self, t: int) -> np.ndarray:
        """Line ``t`` of every document that has one."""
        return self.begin[: np.searchsorted(-self.sorted, -t, side="left")] + t


def viterbi(scores: np.ndarray, lengths: np.ndarray, field: Field) -> np.ndarray:
    """The most likely state of every line."""
    walk = Sequences(lengths)
    out, back = np.zeros(len(scores), np.int64), np.zeros(scores.shape, np.int64)
    if not walk.steps:
        return out
    best = field.start + scores[walk.rows(0)]
    for t in range(1, walk.steps):
        rows = walk.rows(t)
        ways = best[: len(rows), :, None] + field.transition
        back[rows] = ways.argmax(axis=1)
        best[: len(rows)] = ways.max(axis=1) + scores[rows]
    state = best.argmax(axis=1)
    for t in range(walk.steps - 1, -1, -1):
        rows = walk.rows(t)
        out[rows] = state[: len(rows)]
        state[: len(rows)] = back[rows, state[: len(rows)]]
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _expected(scores: np.ndarray, walk: Sequences, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the lines' states, and expected transitions and first states (forward-backward)."""
    forward, backward = np.zeros(scores.shape), np.zeros(scores.shape)
    first = walk.rows(0)
    forward[first] = field.start + scores[first]
    for t in range(1, walk.steps):
        rows = walk.rows(t)
        forward[rows] = _log_sum(forward[rows - 1][:, :, None] + field.transition, 1) + scores[rows]
    pairs = np.zeros((2, 2))
    total = np.zeros(len(scores))
    last = walk.begin + walk.sorted - 1
    norm = _log_sum(forward[last], 1)
    for t in range(walk.steps - 1, 0, -1):
        rows = walk.rows(t)
        ahead = field.transition + (scores[rows] + backward[rows])[:, None, :]
        backward[rows - 1] = _log_sum(ahead, 2)
        pairs += np.exp(forward[rows - 1][:, :, None] + ahead - norm[: len(rows), None, None]).sum(axis=0)
    for t in range(walk.steps):
        rows = walk.rows(t)
        total[rows] = norm[: len(rows)]
    marginal = np.exp(forward + backward - total[:, None])
    return marginal, pairs, marginal[first].sum(axis=0)


def fit(features: np.ndarray, lengths: np.ndarray, labels: np.ndarray, rounds: int = 120, decay: float = 1e-3) -> Field:
    """Weights by gradient ascent (Adam) on the mean conditional log likelihood with a squared penalty."""
    walk = Sequences(lengths)
    truth = np.eye(2)[labels]
    begin = np.cumsum(lengths) - lengths
    follows = np.ones(len(labels), bool)
    follows[begin] = False
    after = np.flatnonzero(follows)
    pairs = truth[after - 1].T @ truth[after]
    goal = np.concatenate([(features.T @ truth).ravel(), pairs.ravel(), truth[begin].sum(axis=0)])
    w, m, v = np.zeros(len(goal)), np.zeros(len(goal)), np.zeros(len(goal))
    n = features.shape[1] * 2
    as_field = lambda w: Field(w[:n].reshape(-1, 2), w[n : n + 4].reshape(2, 2), w[n + 4 :])
    for k in range(1, rounds + 1):
        field = as_field(w)
        marginal, both, first = _expected(features @ field.emission, walk, field)
        got = np.concatenate([(features.T @ marginal).ravel(), both.ravel(), first])
        gradient = (goal - got) / len(labels) - decay * w
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        w = w + 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return as_field(w)


def train(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = 1500, lines: int = 200,
) -> Field | None:
    """Fit the field on at most ``sample`` labelled documents, chosen by a hash of their id, and at most ``lines`` lines
    of each. Without labelled documents of both kinds there is nothing to learn from and the result is None."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)

    @F.arrow_udf("array<double>")
    def rows(column: pa.Array) -> pa.Array:
        return pa.array([described(t)[1][:lines].ravel() for t in bytes_of(column)], pa.list_(pa.float64()))

    texts = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = texts.join(F.broadcast(known), "_id").select("_id", "_label", rows("_text").alias("_rows")).toPandas()
    found = found.sort_values("_id").drop_duplicates("_id")
    found = found[found["_rows"].map(len) > 0]
    if found["_label"].nunique() < 2:
        return None
    lengths = found["_rows"].map(len).to_numpy() // N_FEATURES
    features = np.concatenate(found["_rows"].to_list()).reshape(-1, N_FEATURES)
    state = np.where(found["_label"].to_numpy() > 0, CONTENT, BOILERPLATE)
    return fit(features, lengths, np.repeat(state, lengths))


# ---------------------------------------------------------------------------------------------- all documents


def judge(texts: list[bytes], field: Field | None) -> list[tuple]:
    """Base counts, and words on content lines, of each text."""
    all_of = [described(t) for t in texts]
    lengths = np.array([len(n) for _, _, n in all_of], np.int64)
    words = np.concatenate([n for _, _, n in all_of]) if all_of else np.zeros(0, np.int64)
    if field is None:
        states = np.full(len(words), CONTENT)
    else:
        features = np.concatenate([f for _, f, _ in all_of]) if all_of else np.zeros((0, N_FEATURES))
        states = viterbi(features @ field.emission, lengths, field)
    owner = np.repeat(np.arange(len(texts)), lengths)
    content = np.bincount(owner, words * (states == CONTENT), len(texts)).astype(np.int64)
    return [(*base, int(c)) for (base, _, _), c in zip(all_of, content)]


def measured(text: Column, field: Field | None) -> Column:
    """Struct of the base counts and ``content_words`` of a text column."""
    names = [*BASE, "content_words"]

    @F.arrow_udf(", ".join(f"{n} long" for n in names))
    def measure(column: pa.Array) -> pa.Array:
        texts, rows = bytes_of(column), []
        for a, b in by_size([len(t) for t in texts], BATCH_BYTES):
            rows += judge(texts[a:b], field)
        columns = zip(*rows) if rows else [[] for _ in names]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return measure(text)


def failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def verdict(measures: str, share: float = 0.5) -> Column:
    """Passes the base rules, and at least ``share`` of the words are on content lines."""
    enough = F.col(f"{measures}.content_words") >= share * F.col(f"{measures}.n_words")
    return ~failed(F.col(f"{measures}.n_words"), F.col(f"{measures}.n_repeat_words")) & enough


def quality(df: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, base counts, ``base_failed``, ``kept``, ``content_words``.

    Null or empty text has no words and fails the base rules. A null id stays null, repeated rows are judged one by one,
    other columns are not read, an empty table gives no rows. Without a field every line counts as content.
    """
    out = df.select(F.col(id_col), measured(F.col(text_col), field).alias("_m"))
    base_failed = failed(F.col("_m.n_words"), F.col("_m.n_repeat_words")).alias("base_failed")
    counts = [F.col(f"_m.{n}") for n in BASE]
    return out.select(id_col, *counts, base_failed, verdict("_m").alias("kept"), "_m.content_words")
