"""Subject areas of conversations: one-versus-rest linear classifiers on hashed word n-grams.

A prompt is cut into sentences, codes left out. A classifier per subject scores each sentence, and one more tells the
sentences that only mention a subject in passing, which lowers their scores; a conversation has the subjects that one of
its sentences reaches the subject's threshold for. All are fitted on the driver on a bounded sample: conversations with
true labels, the subjects' descriptions, and conversations with weak labels, which follow from the section metadata they
were filed under (the coarse kind, and how the labelled conversations spread over each kind) together with the seed
classifiers. What is said in passing is learned from sentences that classifiers fitted on other conversations give a
subject that their own conversation lacks. Thresholds are calibrated by cross-fitting on the labelled ones. Scoring is one
narrow pass over all messages with a fixed-size weight matrix.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlode.functions.text import role
from chatlode.llm.conversations import CATCH_ALL
from chatlode.session import table

#: Buckets of the hashed n-grams; bounds of the samples that the fit sees.
BUCKETS = 1 << 17
LABELLED, WEAK, ROWS = 10_000, 8_000, 60_000

_SENT = re.compile(r"[^.!?。！？\n]+[.!?。！？\n]*")
_CODE = re.compile(r"`[^`\n]*`|[#*]?[!-~]*\d[!-~]*|\S+@\S+|\bjob-\S+|\S+\.log\b")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CJK = re.compile(r"[぀-ヿ㐀-鿿々]+")


def units(text: str) -> list[str]:
    """Sentences of a prompt that may tell what it asks about, normalised."""
    t = unicodedata.normalize("NFKC", text) if not text.isascii() else text
    t = re.sub(r"[​‌‍⁠﻿]", "", t).lower()
    t = re.sub(r"(?<=[^\W\d_]),?[ \t]*\r?\n[ \t]*(?=[^\W\d_])", lambda m: " " if "\n" in m[0] else m[0], t)
    out = []
    for s in _SENT.findall(t):
        s = " ".join(_CODE.sub(" ", s).split())
        if len(s) > 2:
            out.append(s)
    return out


def grams(sentence: str) -> list[int]:
    """Buckets of the word 1- to 3-grams of a sentence; in scripts without spaces every character is a word, up to 4-grams."""
    got = set()
    for run in _CJK.findall(sentence):
        for n in (2, 3, 4):
            for i in range(len(run) - n + 1):
                got.add(zlib.crc32(run[i : i + n].encode()) % BUCKETS)
    words = _WORD.findall(_CJK.sub(" ", sentence))
    for n in (1, 2, 3):
        for i in range(len(words) - n + 1):
            got.add(zlib.crc32(" ".join(words[i : i + n]).encode()) % BUCKETS)
    return sorted(got)


class Linear:
    """One-versus-rest logistic regressions on binary hashed features of unit length, fitted by AdaGrad over mini-batches."""

    def __init__(self, classes: int):
        self.w = np.zeros((BUCKETS, classes), np.float32)
        self.b = np.full(classes, -2.0, np.float32)

    def fit(self, rows: list[list[int]], y: np.ndarray, weight: np.ndarray, epochs: int = 6, rate: float = 0.6, l2: float = 1e-5, batch: int = 256, seed: int = 7) -> "Linear":
        rng = np.random.default_rng(seed)
        k = self.w.shape[1]
        sq_w, sq_b = np.full(self.w.shape, 1e-4, np.float32), np.full(self.b.shape, 1e-4, np.float32)
        sizes = np.array([len(r) for r in rows])
        flat, ptr = np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum())), np.r_[0, np.cumsum(sizes)]
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                ids = order[at : at + batch]
                n = sizes[ids]
                starts = np.r_[0, np.cumsum(n)[:-1]]
                cells = flat[np.repeat(ptr[ids] - starts, n) + np.arange(int(n.sum()))]
                scale = (1 / np.sqrt(n)).astype(np.float32)
                z = np.add.reduceat(self.w[cells], starts, axis=0) * scale[:, None] + self.b
                g = (1 / (1 + np.exp(-z)) - y[ids]) * weight[ids][:, None]
                cols, inv = np.unique(cells, return_inverse=True)
                each = np.repeat(g * scale[:, None], n, axis=0)
                gw = np.stack([np.bincount(inv, each[:, c], len(cols)) for c in range(k)], axis=1).astype(np.float32)
                gw += l2 * self.w[cols]
                sq_w[cols] += gw**2
                self.w[cols] -= rate * gw / np.sqrt(sq_w[cols])
                gb = g.sum(0)
                sq_b += gb**2
                self.b -= rate * gb / np.sqrt(sq_b)
        return self

    def score(self, row: list[int]) -> np.ndarray:
        if not row:
            return self.b * 0 - 9
        return self.w[row].sum(0) / np.sqrt(len(row)) + self.b


def _train(convs: list[tuple[list[str], set[int], float]], classes: int, memo: dict, refine: int = 1) -> Linear:
    """Fit on conversations. A distinct sentence is one row; its target is the mean over the conversations that hold it.
    Then each sentence keeps, of its conversations' subjects, those it supports itself, and the fit is done again."""
    texts: dict[str, int] = {}
    pairs: dict[tuple[int, frozenset], float] = {}
    for sents, subjects, weight in convs:
        label = frozenset(subjects)
        for u in set(sents):
            if u not in memo:
                memo[u] = grams(u)
            if memo[u]:
                k = texts.setdefault(u, len(texts))
                pairs[(k, label)] = pairs.get((k, label), 0.0) + weight / max(1, len(label))
    model = Linear(classes)
    if not texts:
        return model
    rows = [memo[u] for u in texts]

    def targets(sharp: Linear | None):
        y, w = np.zeros((len(rows), classes), np.float32), np.zeros(len(rows), np.float32)
        for (k, label), n in pairs.items():
            w[k] += n
            if sharp is None:
                for c in label:
                    y[k, c] += n
            elif label:
                s = scores[k]
                top = max(s[c] for c in label)
                for c in label:
                    y[k, c] += n * (top > -3 and s[c] >= top - 0.7)
        return y / w[:, None], np.minimum(w, 4)

    model.fit(rows, *targets(None))
    for _ in range(refine):
        scores = [model.score(r) for r in rows]
        model = Linear(classes).fit(rows, *targets(model))
    return model


#: What a sentence that is said in passing loses: PASSING times its score for that, from -MARGIN on.
PASSING, MARGIN = 2.0, 1.0


def _passing(part: list, classes: int, memo: dict, folds: int = 2, least: float = -1.0) -> Linear:
    """A classifier of sentences that only mention a subject: those that classifiers fitted on other conversations give a subject
    which their own conversation lacks, against those whose subject it has."""
    seen: dict[str, list[int]] = {}
    for k in range(folds):
        model = _train([(t, s, 1.0) for i, (t, s, _) in enumerate(part) if i % folds != k], classes, memo)
        for sents, subjects, _ in part[k::folds]:
            for u in set(sents):
                if row := memo.get(u) or memo.setdefault(u, grams(u)):
                    s = model.score(row)
                    top = int(s.argmax())
                    if s[top] >= least:
                        seen.setdefault(u, [0, 0])[top in subjects] += 1
    n = np.array([sum(x) for x in seen.values()], np.float32).reshape(-1)
    y = np.array([[x[0] / sum(x)] for x in seen.values()], np.float32).reshape(-1, 1)
    return Linear(1).fit([memo[u] for u in seen], y, np.minimum(n, 4), epochs=8) if seen else Linear(1)


def _best(model: Linear, aside: Linear, texts: list[str], memo: dict) -> np.ndarray:
    out = np.full(len(model.b), -9.0)
    for u in texts:
        if row := memo.get(u) or memo.setdefault(u, grams(u)):
            out = np.maximum(out, model.score(row) - PASSING * max(0.0, float(aside.score(row)[0]) + MARGIN))
    return out


def fit(labelled: list[tuple[list[str], set[int], str | None]], weak: list[tuple[list[str], str | None]], classes: int, folds: int = 2, described: list[tuple[list[str], set[int], float]] = ()) -> tuple[Linear, Linear, np.ndarray]:
    """(model, model of what is said in passing, thresholds). `labelled`: sentences, subjects and kind of each conversation;
    `weak`: sentences and kind; `described`: sentences of the subjects' descriptions."""
    memo: dict[str, list[int]] = {}
    kinds: dict[str, np.ndarray] = {}
    for _, subjects, kind in labelled:
        row = kinds.setdefault(kind or "", np.full(classes, 0.3))
        for s in subjects:
            row[s] += 1

    def whole(part):
        """Seed on true labels, then with the weak ones it is sure of and the kind allows."""
        base = [(t, s, 1.0) for t, s, _ in part] + list(described)
        aside = _passing(part, classes, memo)
        seed = _train(base, classes, memo)
        more = []
        for texts, kind in weak:
            prior = kinds.get(kind or "", np.ones(classes))
            prior = np.log(prior / prior.sum() * classes)
            s = _best(seed, aside, texts, memo) + 0.5 * prior
            top = int(s.argmax())
            found = set(np.flatnonzero(s > 0.5).tolist())
            if not found and s[top] > -1.0 and prior[top] > 0.5:
                found = {top}
            if found:
                more.append((texts, found, 0.5))
        return (_train(base + more, classes, memo) if more else seed), aside

    held = np.zeros((len(labelled), classes))
    if len(labelled) >= 40:
        for k in range(folds):
            model, aside = whole([x for i, x in enumerate(labelled) if i % folds != k])
            for i in range(k, len(labelled), folds):
                held[i] = _best(model, aside, labelled[i][0], memo)
    truth = np.array([[c in s for c in range(classes)] for _, s, _ in labelled], bool).reshape(-1, classes)
    cuts = np.zeros(classes)
    for c in range(classes):
        best = (-1.0, 0.0)
        for cut in np.arange(-2.5, 2.6, 0.1):
            got = held[:, c] >= cut
            hit = (got & truth[:, c]).sum()
            f1 = 2 * hit / max(1, got.sum() + truth[:, c].sum())
            if f1 > best[0] + 1e-9:
                best = (f1, cut)
        # The models of the folds see less than the last one and are less sure: the cut moves towards 0.2, where they agree.
        cuts[c] = (best[1] + 0.3) / 1.3 if len(labelled) >= 40 else 0.0
    return (*whole(labelled), cuts)


def _sample(messages: DataFrame, analysis: DataFrame, labels: DataFrame, names: list[str]):
    """Sentences of the sampled conversations with their labels and kinds; at most ROWS prompts of each sample."""
    at = {s: i for i, s in enumerate(names)}
    prompts = messages.where((role(F.col("role")) == "user") & F.col("text").isNotNull() & F.col("conversation_id").isNotNull() & (F.col("conversation_id") != CATCH_ALL)).select("conversation_id", "text")
    kinds = analysis.where("conversation_id is not null").groupBy("conversation_id").agg(F.max_by(F.lower(F.trim("kind")), F.coalesce("analyzed_at", F.lit(0).cast("timestamp"))).alias("kind"))
    known = labels.where("conversation_id is not null and subject is not null").groupBy("conversation_id").agg(F.collect_set("subject").alias("subjects"))
    known = known.orderBy(F.xxhash64("conversation_id")).limit(LABELLED)
    true = known.join(kinds, "conversation_id", "left")
    weak = kinds.join(known, "conversation_id", "left_anti").orderBy(F.xxhash64("conversation_id")).limit(WEAK)
    out = []
    for rows in (true, weak):  # bounded by their limits, so that they can be broadcast and no text is shuffled
        cols = ["conversation_id", "kind"] + (["subjects"] if "subjects" in rows.columns else [])
        got = prompts.join(F.broadcast(rows.select(*cols)), "conversation_id").orderBy(F.xxhash64("conversation_id", "text"), "conversation_id", "text").limit(ROWS).collect()
        convs: dict[str, list] = {}
        for r in got:
            convs.setdefault(r["conversation_id"], [[], {at[s] for s in (r["subjects"] if "subjects" in cols else []) if s in at}, r["kind"]])[0].extend(units(r["text"]))
        out.append([convs[c] for c in sorted(convs)])
    return [tuple(x) for x in out[0]], [(x[0], x[2]) for x in out[1]]


def assign(messages: DataFrame, analysis: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """conversation_id, subject of every conversation and each of its subjects.

    Null and blank prompts tell nothing; rows without a conversation and the catch-all conversation are no cases. Repeated
    rows change nothing; an empty table gives an empty result.
    """
    names = sorted(r[0] for r in subjects.select("subject").where("subject is not null").distinct().limit(1000).collect())
    labelled, weak = _sample(messages, analysis, labels, names)
    told = {r[0]: r[1] for r in subjects.groupBy("subject").agg(F.first("description")).limit(1000).collect()} if "description" in subjects.columns else {}
    described = [(units(told[n]), {k}, 1.0) for k, n in enumerate(names) if told.get(n)]
    model, aside, cuts = fit(labelled, weak, len(names), described=described)
    both = np.concatenate([model.w, aside.w], axis=1)
    used = np.flatnonzero(np.any(both != 0, axis=1))
    weights, bias = both[used].astype(np.float16), np.concatenate([model.b, aside.b])
    sc = messages.sparkSession.sparkContext
    shipped = sc.broadcast((used.astype(np.int32), weights, bias, cuts))  # at most BUCKETS rows

    def run(batches):
        used, weights, bias, cuts = shipped.value
        full = np.zeros((BUCKETS, len(bias)), np.float32)
        full[used] = weights
        seen: dict[str, int] = {}
        for b in batches:
            convs, bits = [], []
            for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = 0
                for u in units(t):
                    m = seen.get(u)
                    if m is None:
                        if len(seen) > 100_000:
                            seen.clear()
                        g = grams(u)
                        m = 0
                        if g:
                            s = full[g].sum(0) / np.sqrt(len(g)) + bias
                            for k in np.flatnonzero(s[:-1] - PASSING * max(0.0, float(s[-1]) + MARGIN) >= cuts):
                                m |= 1 << int(k)
                        seen[u] = m
                    got |= m
                while got:
                    low = got & -got
                    convs.append(c)
                    bits.append(low.bit_length() - 1)
                    got ^= low
            yield pa.RecordBatch.from_arrays([pa.array(convs, pa.string()), pa.array([names[k] for k in bits], pa.string())], names=["conversation_id", "subject"])

    prompts = messages.where((role(F.col("role")) == "user") & F.col("text").isNotNull() & F.col("conversation_id").isNotNull() & (F.col("conversation_id") != CATCH_ALL)).select("conversation_id", "text")
    return prompts.mapInArrow(run, "conversation_id string, subject string").distinct()


def p3_found(spark, sf_dir: str) -> DataFrame:
    """conversation_id and subject of each subject that a user message of the conversation asks about."""
    return assign(*[table(spark, sf_dir, t) for t in ("messages", "analysis", "subject_labels", "subjects")])


def p3_composition(spark, sf_dir: str) -> DataFrame:
    """Conversations of each subject."""
    return p3_found(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("conversations"))
