"""Toxicity by a small recurrent network, trained and run in numpy.

A text's words enter as two vectors side by side: one of the word (hashed), and the mean of those of its character
trigrams. With under FEW toxic texts in the sample, vectors would be learnt by heart; then a word and each of its trigrams
enter as one number, how much likelier toxic texts have them than others, where in training a text does not count for its
own, so that they tell there what they tell of a new text.

A bidirectional gated recurrent network reads windows of WINDOW words, each STRIDE after the one before, so windows overlap and every word of a text is read; attention pools a window's states to a logit. A text's score is the
sigmoid of its largest logit. In training a text's logit is a soft maximum over its windows, so that only whole texts
need labels.

Training takes at most SAMPLE texts of each label, of at most SAMPLE_CHARS characters, those with the smallest hashes:
the only bounded sample here. All texts are scored, whole. Nothing but the text is an input. A null text is empty, and
an empty one is a window without words. Rows stay as they are: repeated ones, and null ids.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import table

WINDOW, STRIDE = 40, 30
WORDS, TRIGRAMS, WORD_SIZE, CHAR_SIZE, HIDDEN, ATTEND = 1 << 13, 1 << 13, 8, 16, 12, 8
#: Under FEW toxic texts: so many updates, the words' buckets, texts that halve what a word tells, and the most it tells.
FEW, FEW_UPDATES, ODDS, ODDS_OF_FEW, MOST_ODDS = 150, 160, 1 << 17, 2.0, 4.0
SAMPLE, SAMPLE_CHARS, UPDATES, BATCH, SHARP, RARE, DECAY = 1200, 6000, 240, 16, 2.0, 4, 1e-4
LONGEST_WORD, CACHE_WORDS, MOST_WINDOWS = 48, 120_000, 2048
_STRIP = b".,;:!?\"'()[]{}"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; what is longer than LONGEST_WORD bytes is cut into pieces."""
    words = (text or "").encode().lower().split()
    if max(map(len, words), default=0) > LONGEST_WORD:
        words = [w[i : i + LONGEST_WORD] for w in words for i in range(0, len(w), LONGEST_WORD)]
    return words


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word; buckets of all their trigrams (with the blanks around a word), and where each word's begin."""
    bare = [w.strip(_STRIP) or w for w in words]
    ids = np.fromiter(map(zlib.crc32, bare), np.int64, len(bare))
    data = np.frombuffer(b" " + b" ".join(bare) + b" ", np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, bare), np.int64, len(bare))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if len(bare) else np.zeros(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(bare) else np.zeros(0, np.int64)
    at = np.arange(lengths.sum()) - np.repeat(offsets - starts, lengths)
    mixed = (data[at] * 1_000_003 + data[at + 1] * 10_007 + data[at + 2] * 101) * 2_654_435_761
    return ids, (mixed >> 12) % TRIGRAMS, offsets


def spans(n: int) -> list[tuple[int, int]]:
    """Windows of n words: overlapping, the last one ends with the text; one empty window if there are none."""
    return [(s, min(n, s + WINDOW)) for s in range(0, max(1, n - WINDOW + STRIDE), STRIDE)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        size, h = WORD_SIZE + CHAR_SIZE, HIDDEN
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "word": draw(0.1, WORDS, WORD_SIZE), "char": draw(0.3, TRIGRAMS, CHAR_SIZE),
            "in": draw(size**-0.5, 2, size, 3 * h), "bias": np.zeros((2, 3 * h), np.float32), "own": draw(h**-0.5, 2, h, 3 * h),
            "odds": np.zeros(0, np.float32), "char_odds": np.zeros(0, np.float32), "look": draw(h**-0.5, 2 * h, ATTEND), "key": draw(ATTEND**-0.5, ATTEND), "out": draw(h**-0.5, 2 * h), "base": np.full(1, -2, np.float32),
        }

    def vectors(self, ids, trigrams, offsets, keep=None, odds=None) -> np.ndarray:
        counts = np.diff(np.append(offsets, len(trigrams)))[:, None]
        word = self.p["word"][ids % WORDS]
        word = word if keep is None else word * keep
        char = self.p["char"][trigrams]
        if len(self.p["odds"]):  # vectors are zero then
            word[:, 0], char[:, 0] = (self.p["odds"][ids % ODDS], self.p["char_odds"][trigrams]) if odds is None else odds
        return np.concatenate([word, np.add.reduceat(char, offsets) / counts], 1).astype(np.float32)

    def gates(self, x: np.ndarray) -> np.ndarray:
        """What words add to the gates: (2, words, 3 * HIDDEN)."""
        return np.stack([x @ self.p["in"][d] + self.p["bias"][d] for d in (0, 1)])

    def run(self, gates: np.ndarray, index: np.ndarray, trace: bool = False):
        """Logits of windows; index (windows, WINDOW) into gates, -1 where a window is over."""
        n, steps, h = *index.shape, HIDDEN
        mask = (index >= 0).astype(np.float32)
        states, kept = np.zeros((steps, n, 2 * h), np.float32), []
        for d in (0, 1):
            own, state = self.p["own"][d], np.zeros((n, h), np.float32)
            zr, c_own = np.ascontiguousarray(own[:, : 2 * h]), np.ascontiguousarray(own[:, 2 * h :])
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                m = mask[:, t, None]
                g = gates[d][index[:, t]]
                gate = _sigmoid(g[:, : 2 * h] + state @ zr)
                z, r = gate[:, :h] * m, gate[:, h:]
                c = np.tanh(g[:, 2 * h :] + (r * state) @ c_own)
                if trace:
                    kept.append((d, t, state, z, r, c, m))
                state = state + z * (c - state)
                states[t, :, d * h : (d + 1) * h] = state
        look = np.tanh(states @ self.p["look"])
        e = np.where(mask.T > 0, look @ self.p["key"], -30)
        e = np.exp(e - e.max(0)) * (mask.T > 0)
        a = e / np.maximum(e.sum(0), 1e-9)
        pooled = np.einsum("tn,tnk->nk", a, states)
        logits = pooled @ self.p["out"] + self.p["base"][0]
        return (logits, (kept, states, look, a, pooled, mask)) if trace else logits

    def gradients(self, gates, index, x, trace, d_logits) -> tuple[dict, np.ndarray]:
        """Of the parameters, and of x (the words' vectors)."""
        kept, states, look, a, pooled, mask = trace
        h, p = HIDDEN, self.p
        g = {"out": pooled.T @ d_logits, "base": np.array([d_logits.sum()]), "own": np.zeros_like(p["own"]), "in": np.zeros_like(p["in"]), "bias": np.zeros_like(p["bias"])}
        d_pooled = d_logits[:, None] * p["out"]
        d_states = a[:, :, None] * d_pooled[None]
        d_a = np.einsum("tnk,nk->tn", states, d_pooled)
        d_e = a * (d_a - (a * d_a).sum(0))
        d_look = d_e[:, :, None] * p["key"] * (1 - look * look)
        g["key"] = np.einsum("tn,tnk->k", d_e, look)
        g["look"] = np.einsum("tnk,tnj->kj", states, d_look)
        d_states += d_look @ p["look"].T
        d_gates = np.zeros_like(gates)
        of_step = np.zeros((2, index.shape[1], len(index), 3 * h), np.float32)
        carry = None
        last = None
        for d, t, before, z, r, c, m in reversed(kept):
            if d != last:
                carry, last = np.zeros((len(index), h), np.float32), d
            zr, c_own = p["own"][d][:, : 2 * h], p["own"][d][:, 2 * h :]
            up = carry + d_states[t, :, d * h : (d + 1) * h]
            d_c = up * z * (1 - c * c)
            d_z = up * (c - before) * z * (1 - z)  # where the mask is 0, z is 0
            d_rh = d_c @ c_own.T
            d_r = d_rh * before * r * (1 - r)
            d_zr = np.concatenate([d_z, d_r], 1)
            g["own"][d][:, : 2 * h] += before.T @ d_zr
            g["own"][d][:, 2 * h :] += (r * before).T @ d_c
            of_step[d, t, :, : 2 * h], of_step[d, t, :, 2 * h :] = d_zr, d_c
            carry = up * (1 - z) + d_rh * r + d_zr @ zr.T
        d_x = np.zeros_like(x)
        words = index.T.ravel()
        order = np.argsort(words, kind="stable")[np.count_nonzero(words < 0) :]
        used, begins = np.unique(words[order], return_index=True)
        for d in (0, 1):
            d_gates[d][used] = np.add.reduceat(of_step[d].reshape(-1, 3 * h)[order], begins)
            g["in"][d] = x.T @ d_gates[d]
            g["bias"][d] = d_gates[d].sum(0)
            d_x += d_gates[d] @ p["in"][d].T
        return g, d_x


def windows_of(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places (windows, WINDOW) of words that lie text after text, -1 where a window is over; and each window's text."""
    places, owner, first = [], [], 0
    for i, n in enumerate(lengths):
        starts = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
        at = starts[:, None] + np.arange(WINDOW)
        places.append(np.where(at < n, at + first, -1))
        owner.append(np.full(len(starts), i))
        first += n
    return np.concatenate(places), np.concatenate(owner)


def odds_of(n: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The logarithm of how much likelier toxic texts (n[1] of texts[1] have a word) are to have it than others (n[0] of
    texts[0]); what few texts tell counts less, and what none tells is 0."""
    rate = [(n[i] + 0.5) / (texts[i] + 1.0) for i in (0, 1)]
    total = n[0] + n[1]
    return (np.clip(np.log(rate[1] / rate[0]), -MOST_ODDS, MOST_ODDS) * total / (total + ODDS_OF_FEW)).astype(np.float32)


def trained(texts: list[str], labels: list[int], seed: int = 1, updates: int = UPDATES) -> Network:
    """Adam on the cross entropy of soft maxima; classes count alike. Without both labels the network says no to all."""
    net, rng = Network(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:
        net.p["out"][:] = 0
        net.p["base"][:] = 4.0 if labels and labels[0] else -4.0
        return net
    split = [words_of(t) for t in texts]
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))).astype(np.float32)
    # what fewer than RARE texts of the sample hold has no vector of its own: it would only be learnt by heart
    df = {"word": np.zeros(WORDS, np.int64), "char": np.zeros(TRIGRAMS, np.int64)}
    have, chars, of = np.zeros((2, ODDS), np.float32), np.zeros((2, TRIGRAMS), np.float32), np.array([len(y) - y.sum(), y.sum()])
    for words, label in zip(split, labels):
        if words:
            ids, trigrams, _ = features(list(dict.fromkeys(words)))
            df["word"][np.unique(ids % WORDS)] += 1
            df["char"][np.unique(trigrams)] += 1
            have[int(label > 0), np.unique(ids % ODDS)] += 1
            chars[int(label > 0), np.unique(trigrams)] += 1
    few = y.sum() < FEW
    if few:
        net.p["odds"], net.p["char_odds"], updates = odds_of(have, of), odds_of(chars, of), min(updates, FEW_UPDATES)
    often = {k: (n >= (np.inf if few else RARE))[:, None].astype(np.float32) for k, n in df.items()}
    for k, mask in often.items():
        net.p[k] *= mask
    learnt = [k for k in net.p if k not in ("odds", "char_odds")]
    first = {k: np.zeros_like(net.p[k]) for k in learnt}
    second = {k: np.zeros_like(net.p[k]) for k in learnt}
    step, a_round = 0, -(-len(texts) // BATCH)
    total = -(-updates // a_round) * a_round
    for _ in range(total // a_round):  # small samples are seen more often
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            # with few texts a word is another one in texts of the other label
            flat = [(w, few and y[i] > 0) for i in own for w in split[i]]
            known = {w: k for k, w in enumerate(dict.fromkeys(flat))}
            index, owner = windows_of([len(split[i]) for i in own])
            if not known:
                continue
            place = np.fromiter((known[w] for w in flat), np.int64, len(flat))
            index = np.where(index >= 0, place[np.maximum(index, 0)], -1)
            ids, trigrams, offsets = features([w for w, _ in known])
            keep = (rng.random((len(ids), 1)) > 0.3).astype(np.float32)
            odds = None
            if few:
                label = np.fromiter((label for _, label in known), bool, len(known))
                less = np.stack([~label, label]).astype(np.float32)
                each = np.repeat(less, np.diff(np.append(offsets, len(trigrams))), 1)
                odds = odds_of(have[:, ids % ODDS] - less, of[:, None] - less), odds_of(chars[:, trigrams] - each, of[:, None] - each)
            x = net.vectors(ids, trigrams, offsets, keep, odds)
            gates = net.gates(x)
            logits, trace = net.run(gates, index, trace=True)
            top = np.full(len(own), -np.inf)
            np.maximum.at(top, owner, logits)
            e = np.exp(SHARP * (logits - top[owner]))
            sums = np.bincount(owner, e, len(own))
            soft = top + np.log(sums) / SHARP
            d_doc = (_sigmoid(soft) - y[own]) * weight[own] / len(own)
            d_logits = (d_doc[owner] * e / sums[owner]).astype(np.float32)
            grads, d_x = net.gradients(gates, index, x, trace, d_logits)
            grads["word"], grads["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(grads["word"], ids % WORDS, d_x[:, :WORD_SIZE] * keep)
            counts = np.diff(np.append(offsets, len(trigrams)))
            np.add.at(grads["char"], trigrams, np.repeat(d_x[:, WORD_SIZE:] / counts[:, None], counts, 0))
            step += 1
            rate = 0.01 * min(1.0, step / 20) * (1 - 0.9 * step / total)
            for k in learnt:
                v = net.p[k]
                gk = grads[k].astype(np.float32) + (DECAY * v if v.ndim > 1 else 0)
                gk = gk * often[k] if k in often else gk
                first[k] += 0.1 * (gk - first[k])
                second[k] += 0.01 * (gk * gk - second[k])
                v -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


class Scorer:
    """Scores texts; remembers what up to CACHE_WORDS words add to the gates."""

    def __init__(self, net: Network):
        self.net, self.known = net, {}
        self.gates = np.zeros((2, CACHE_WORDS, 3 * HIDDEN), np.float32)

    def _learn(self, words: list[bytes]) -> None:
        n = len(self.known)
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            self.gates[:, n : n + len(part)] = self.net.gates(self.net.vectors(*features(part)))
            self.known.update(zip(part, range(n, n + len(part))))
            n += len(part)

    def _score(self, split: list[list[bytes]]) -> np.ndarray:
        flat = [w for words in split for w in words]
        new = {w for w in flat if w not in self.known}
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = set(flat)
        if new:
            self._learn(list(new))
        place = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        index, owner = windows_of([len(words) for words in split])
        if len(place):
            index = np.where(index >= 0, place[np.maximum(index, 0)], -1)
        logits = np.concatenate([self.net.run(self.gates, index[i : i + MOST_WINDOWS]) for i in range(0, len(index), MOST_WINDOWS)])
        top = np.full(len(split), -np.inf)
        np.maximum.at(top, owner, logits)
        return _sigmoid(top)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """Texts go in parts of about 60,000 words; a longer one goes in overlapping parts of its own, whose best counts."""
        out, held, count = [], [], 0
        for words in map(words_of, texts):
            if len(words) > 60_000:
                if held:
                    out.append(self._score(held))
                    held, count = [], 0
                step = 60_000 // STRIDE * STRIDE
                parts = [words[i : i + step + WINDOW - STRIDE] for i in range(0, len(words), step)]
                out.append(np.array([max(self._score([p])[0] for p in parts)]))
                continue
            held.append(words)
            count += len(words)
            if count >= 60_000:
                out.append(self._score(held))
                held, count = [], 0
        if held:
            out.append(self._score(held))
        return np.concatenate(out) if out else np.zeros(0)


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list[tuple[str, int]]:
    """At most `most` labelled texts of each label, without the held-out rows."""
    own = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.withColumn("h", F.xxhash64("doc_id"))
    chosen = [own.where(F.col("toxic") == t).orderBy("h", "doc_id").limit(most) for t in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text").join(few, "doc_id").select("h", "doc_id", "text", "toxic")
    return [(r.text, int(r.toxic)) for r in sorted(rows.collect(), key=lambda r: (r.h, r.doc_id, r.text))]


def held_out(doc_id: str):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fitted(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Network:
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    rows = sample(docs, labels, most)
    return trained([t for t, _ in rows], [y for _, y in rows])


def scored(docs: DataFrame, net: Network, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 (higher: more likely toxic), in place of a column of that name."""
    keep = [c for c in docs.columns if c != score]
    model = docs.sparkSession.sparkContext.broadcast(net.p)
    pick = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.__new__(Network)
        own.p = model.value
        scorer = Scorer(own)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scorer(part.column(part.num_columns - 1).to_pylist()), pa.float64())], names=[*keep, score])

    return pick.mapInArrow(tasks, pick.drop("__text").selectExpr("*", f"0D AS `{score}`").schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: a score for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fitted(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = scored(docs.select("doc_id", "text", held_out("doc_id").alias("held_out")), net)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
