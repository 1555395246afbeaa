"""Toxicity by weak supervision.

1. A bounded sample of labelled rows (``SAMPLE`` rows by hash of doc_id, near copies once) shows
   which words and word beginnings go with the label; these are dealt to lexicon voters.  Fixed
   word lists and two text patterns vote too.
2. Every document is voted on.  A generative label model (class prior, hit rate of every voter in
   either class) is fitted by expectation maximisation to the counts of all vote patterns of the
   corpus; what two voters share beyond the classes is their correlation, and correlated voters
   count for less.
3. The model's posteriors label the sample's documents, and a linear classifier over words, word
   beginnings and votes is trained on them.  It scores every text.

Labels decide nothing but the lexicons and the start of the label model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codescan.llm.words import ALNUM, U64, Words, blocks, mix, signed
from codescan.session import cut_lineage

SAMPLE = 20_000      # labelled rows that the lexicons and the classifier are fitted on
TERMS = 600          # mined terms, dealt to the lexicon voters
FEATURES = 2_000     # terms the classifier weighs
LEXICONS = 12
PRECISION = 0.8      # least share of a mined term's texts that are toxic
THRESHOLD = 0.3

# Fixed lists of insults, by group of languages.
WORD_LISTS = {
    "english": ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "scum", "trash", "loser", "losers", "clown",
                "pathetic", "worthless", "disgusting", "imbecile", "jerk", "bastard", "bitch", "asshole", "retard"),
    "others": ("arschloch", "dummkopf", "trottel", "depp", "abschaum", "connard", "salaud", "crétin", "imbécile",
               "ordure", "idiota", "estúpido", "imbécil", "basura", "escoria", "pendejo"),
}
VOTERS = LEXICONS + len(WORD_LISTS) + 2  # two patterns: shouting, runs of exclamation marks
PREFIXES = (4, 5)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 2 by 4; no id, not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _terms(words: Words, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of all words and of the beginnings of longer words; sorted by text, each term once.

    With ``wanted``, sorted codes, only these terms are looked for.
    """
    return _terms_in_context(words, wanted)[:2]


def _found(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which codes are among the wanted ones; their low bits rule out most at once."""
    low = np.zeros(1 << 16, dtype=bool)
    low[(wanted & U64(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(low[(codes & U64(0xFFFF)).astype(np.int64)])
    if not len(maybe):
        return maybe
    at = np.minimum(np.searchsorted(wanted, codes[maybe]), len(wanted) - 1)
    return maybe[wanted[at] == codes[maybe]]


def _beginning(words: Words, n: int) -> np.ndarray:
    """The hash of the first ``n`` bytes of each word; a shorter word is filled with its last byte."""
    at = np.minimum(words.start[:, None] + np.arange(n), words.end[:, None] - 1)
    packed = (words.data[at].astype(U64) << (U64(8) * np.arange(n, dtype=U64))).sum(axis=1, dtype=U64)
    return mix(packed + (U64(n) << U64(56)))


def _terms_in_context(words: Words, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts and terms as above, the hash of the word before the term's first place, and of the term's beginning."""
    doc, length, whole = words.doc(), words.end - words.start, words.hashes()
    before, stem = np.r_[U64(0), whole[:-1]][:len(whole)], _beginning(words, PREFIXES[0])
    code, row = [whole], [np.arange(len(words))]
    for n in PREFIXES:
        long = length > n
        code.append((stem if n == PREFIXES[0] else _beginning(words, n))[long])
        row.append(np.flatnonzero(long))
    code, row = np.concatenate(code), np.concatenate(row)
    if wanted is not None:
        place = _found(code, wanted)
        code, row = code[place], row[place]
    order = np.lexsort((code, doc[row]))
    code, row = code[order], row[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (doc[row[1:]] != doc[row[:-1]])
    code, row = code[new], row[new]
    return doc[row], code, before[row], stem[row]


def word_code(word: str) -> np.uint64:
    return Words(pa.array([word]), ALNUM, lower=True).hashes()[0]


def _patterns(texts: pa.Array) -> np.ndarray:
    """Two votes for each text: mostly capitals, and three or more runs of exclamation marks."""
    words = Words(texts)
    data, at = words.data, words.offsets

    def per_text(mask):
        total = np.r_[0, np.cumsum(mask)]
        return total[at[1:]] - total[at[:-1]]

    upper = per_text((data >= 0x41) & (data <= 0x5A))
    lower = per_text((data >= 0x61) & (data <= 0x7A))
    mark = data == 0x21
    runs = per_text(mark & np.r_[mark[1:], False]) if len(mark) else np.zeros(words.n_docs, dtype=np.int64)
    return np.stack([(upper > 20) & (upper > lower), runs >= 3])


@dataclass
class Model:
    """What is learnt: which voter each term belongs to, the label model and the classifier."""

    terms: np.ndarray  # sorted codes of mined and listed words
    voter: np.ndarray
    hit_toxic: np.ndarray = field(default_factory=lambda: np.zeros(VOTERS))
    hit_clean: np.ndarray = field(default_factory=lambda: np.zeros(VOTERS))
    none_toxic: float = 0.1
    none_clean: float = 0.9
    weight: np.ndarray = field(default_factory=lambda: np.ones(VOTERS))
    correlation: np.ndarray = field(default_factory=lambda: np.zeros((VOTERS, VOTERS)))
    prior: float = 0.1
    features: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=U64))
    feature_weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vote_weights: np.ndarray = field(default_factory=lambda: np.zeros(VOTERS))
    bias: float = 0.0

    def votes(self, texts: pa.Array, docs: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """A bit for each voter that votes a text toxic; the others abstain."""
        out = np.zeros(len(texts), dtype=np.int64)
        if len(self.terms) and len(codes):
            at = np.minimum(np.searchsorted(self.terms, codes), len(self.terms) - 1)
            found = self.terms[at] == codes
            np.bitwise_or.at(out, docs[found], np.int64(1) << self.voter[at[found]])
        for i, votes in enumerate(_patterns(texts)):
            out |= votes.astype(np.int64) << (VOTERS - 2 + i)
        return out

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        """Probability of the label given the votes; a single abstention tells nothing, that of all voters does."""
        bits = _bits(masks)
        hit = (np.log(self.hit_toxic) - np.log(self.hit_clean)) * self.weight
        none = np.log(self.none_toxic) - np.log(self.none_clean)
        return _sigmoid(np.log(self.prior / (1 - self.prior)) + bits @ hit + (masks == 0) * none)

    def score(self, texts: pa.Array) -> np.ndarray:
        docs, codes = _terms(Words(texts, ALNUM, lower=True), np.union1d(self.terms, self.features))
        total = self.bias + _bits(self.votes(texts, docs, codes)) @ self.vote_weights
        if len(self.features) and len(codes):
            at = np.minimum(np.searchsorted(self.features, codes), len(self.features) - 1)
            found = self.features[at] == codes
            total += np.bincount(docs[found], self.feature_weights[at[found]], minlength=len(texts))
        return _sigmoid(total)


def _bits(masks: np.ndarray) -> np.ndarray:
    return ((masks[:, None] >> np.arange(VOTERS)) & 1).astype(np.float64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, size: int) -> DataFrame:
    """(toxic, text) of the sampled documents; near copies with one label, by three least shingle hashes, count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = Words(block.column(1), ALNUM, lower=True)
            one, start = words.hashes(), words.first[:-1]
            three = mix(one[:-2] + U64(3) * one[1:-1] + U64(5) * one[2:]) if len(one) > 2 else one[:0]
            sketch = np.zeros((3, words.n_docs), dtype=U64)
            for i, n in enumerate(words.count):
                part = three[start[i]:start[i] + n - 2] if n > 2 else one[start[i]:start[i] + n]
                if len(part):
                    sketch[:, i] = [mix(part ^ U64(seed)).min() for seed in (0, 0x5BD1E995, 0xC2B2AE35)]
            for k in range(3):
                block = block.append_column(f"s{k}", signed(sketch[k]))
            yield block

    known = labels.where(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(size)  # the bound of what is broadcast below
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(known), rows["doc_id"] == known["_id"]).select("doc_id", "text", "toxic")
    rows = rows.mapInArrow(run, "doc_id long, text string, toxic int, s0 long, s1 long, s2 long")
    return rows.groupBy("toxic", "s0", "s1", "s2").agg(F.min_by("text", "doc_id").alias("text")).select("toxic", "text")


def _supports(rows: DataFrame, candidates: int) -> tuple[int, pa.Table]:
    """(terms tested, the likeliest candidates with their supports among toxic and other texts).

    A term is supported by texts (p, n) and by the different words that come before it (p_before,
    n_before): a passage that many texts share, or a group of near copies, has one such word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            docs, codes = _terms(Words(block.column(1), ALNUM, lower=True))
            toxic = (block.column(0).to_numpy() != 0)[docs]
            term, place = np.unique(codes, return_inverse=True)
            p = np.bincount(place, toxic, minlength=len(term)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [signed(term), pa.array(p), pa.array(np.bincount(place, minlength=len(term)) - p)], ["term", "p", "n"])

    sizes = rows.agg(F.sum((F.col("toxic") != 0).cast("int")), F.count(F.lit(1))).first()
    share = max((sizes[0] or 0) / max(1, sizes[1]), 1e-9)
    seen = rows.mapInArrow(count, "term long, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    seen = cut_lineage(seen.where("p >= 3"))
    tested = max(1, seen.count())
    gain = F.expr("p * ln(p / (p + n))") - F.col("p") * float(np.log(share))
    wanted = np.sort(seen.orderBy(gain.desc(), "term").limit(candidates).select("term").toArrow().column(0).to_numpy().view(U64))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            docs, codes, before, stem = _terms_in_context(Words(block.column(1), ALNUM, lower=True))
            if len(wanted) and len(codes):
                at = np.minimum(np.searchsorted(wanted, codes), len(wanted) - 1)
                found = wanted[at] == codes
                toxic = (block.column(0).to_numpy() != 0)[docs[found]]
                yield pa.RecordBatch.from_arrays(
                    [signed(codes[found]), pa.array(toxic.astype(np.int32)), signed(before[found]), signed(stem[found])],
                    ["term", "toxic", "before", "stem"])

    pairs = rows.mapInArrow(contexts, "term long, toxic int, before long, stem long").distinct()
    pairs = pairs.groupBy("term").agg(F.min("stem").alias("stem"), F.sum("toxic").alias("p_before"), F.sum(1 - F.col("toxic")).alias("n_before"))
    return tested, pairs.join(seen, "term").toArrow()


def _mine(counts: pa.Table, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms by how surely they go with the label, by either support, the surest first.

    Returns (codes, beginnings, log-likelihood ratio, share of the term's texts that are toxic).
    """
    code = counts.column("term").to_numpy().view(U64)
    share = np.clip(n_toxic / max(1, n_toxic + n_clean), 1e-9, 1 - 1e-9)
    ratio = np.full(len(code), np.inf)
    for p, n in (("p", "n"), ("p_before", "n_before")):
        p, n = counts.column(p).to_numpy().astype(float), counts.column(n).to_numpy().astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            one = 2 * (np.where(p > 0, p * np.log(p / ((p + n) * share)), 0)
                       + np.where(n > 0, n * np.log(n / ((p + n) * (1 - share))), 0))
        ratio = np.minimum(ratio, np.where(p > (p + n) * share, one, -one))
    p, n = counts.column("p").to_numpy(), counts.column("n").to_numpy()
    order = np.lexsort((code, -ratio))
    return code[order], counts.column("stem").to_numpy().view(U64)[order], ratio[order], (p / (p + n + 1))[order]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample: int = SAMPLE) -> Model:
    """The three steps.  Without a labelled row of either class the fixed lists alone vote."""
    rows = cut_lineage(_sample(docs, labels, id_col, text_col, label_col, sample))
    sizes = {r[0]: r[1] for r in rows.groupBy((F.col("toxic") != 0).alias("toxic")).count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    tested, supports = _supports(rows, 4 * FEATURES)
    codes, stems, ratio, precision = _mine(supports, n_toxic, n_clean)
    # One of a hundred chosen terms may be chance: step-up over the tail of the ratio, exp(-ratio / 2).
    passing = np.flatnonzero(ratio > 2 * np.log(tested / (0.01 * np.arange(1, len(ratio) + 1))))
    sure = np.arange(passing[-1] + 1 if len(passing) else 0)
    sure = sure[precision[sure] >= PRECISION][:TERMS]
    # A word and its beginnings belong to one voter, or voters would only repeat each other.
    owner = {int(c): int(s % U64(LEXICONS)) for c, s in zip(codes[sure], stems[sure])}
    for i, words in enumerate(WORD_LISTS.values()):
        for code in map(word_code, words):
            owner.setdefault(int(code), LEXICONS + i)
    terms = np.array(sorted(owner), dtype=U64)
    model = Model(terms, np.array([owner[int(t)] for t in terms], dtype=np.int64))
    _label_model(model, _corpus_votes(docs, text_col, model), _sample_votes(rows, model), n_toxic, n_clean)
    _classifier(model, rows, codes[ratio > 0][:FEATURES])
    return model


def _sample_votes(rows: DataFrame, model: Model) -> pa.Table:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            votes = model.votes(block.column(1), *_terms(Words(block.column(1), ALNUM, lower=True)))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(votes)], ["toxic", "mask"])

    return rows.mapInArrow(run, "toxic int, mask long").groupBy("toxic", "mask").count().toArrow()


def _corpus_votes(docs: DataFrame, text_col: str, model: Model) -> pa.Table:
    """How often each pattern of votes occurs in the whole corpus: 2**VOTERS rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = block.column(0)
            mask, n = np.unique(model.votes(texts, *_terms(Words(texts, ALNUM, lower=True), model.terms)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(mask), pa.array(n)], ["mask", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "mask long, n long")
    return rows.groupBy("mask").agg(F.sum("n").alias("n")).toArrow()


def _label_model(model: Model, corpus: pa.Table, seen: pa.Table, n_toxic: int, n_clean: int,
                 rounds: int = 30) -> None:
    """Hit rates of every voter in either class and the correlations of voters.

    The rates start from the labelled sample, which also counts as much as the corpus, so that
    the classes keep their meaning and do not become many hits and few.
    """
    toxic = seen.column("toxic").to_numpy() != 0
    bits, times = _bits(seen.column("mask").to_numpy()), seen.column("count").to_numpy().astype(float)
    start_toxic = (times[toxic] @ bits[toxic] + 0.5) / (n_toxic + 1)
    start_clean = (times[~toxic] @ bits[~toxic] + 0.5) / (n_clean + 1)
    listed = np.arange(VOTERS) >= LEXICONS
    if not n_toxic:
        start_toxic = np.where(listed, 0.3, 0.01)
    if not n_clean:
        start_clean = np.full(VOTERS, 0.01)
    start_prior = (n_toxic + 1) / (n_toxic + n_clean + 10)
    silent = seen.column("mask").to_numpy() == 0
    none_toxic, none_clean = (times[toxic & silent].sum() + 1) / (n_toxic + 10), (times[~toxic & silent].sum() + 9) / (n_clean + 10)
    masks, counts = corpus.column("mask").to_numpy(), corpus.column("n").to_numpy().astype(float)
    bits, part = _bits(masks), [start_prior * counts.sum(), (1 - start_prior) * counts.sum()]
    for _ in range(2):  # the second time with the weights of correlated voters
        model.prior, model.hit_toxic, model.hit_clean = start_prior, _clip(start_toxic), _clip(start_clean)
        model.none_toxic, model.none_clean = none_toxic, none_clean
        for _ in range(rounds if len(masks) else 0):
            post = model.posterior(masks) * counts
            rest = counts - post
            toxic_n, clean_n = post.sum() + part[0], rest.sum() + part[1]
            model.hit_toxic = _clip((post @ bits + part[0] * start_toxic) / toxic_n)
            model.hit_clean = _clip((rest @ bits + part[1] * start_clean) / clean_n)
            model.none_toxic = float((post[masks == 0].sum() + part[0] * none_toxic) / toxic_n)
            model.none_clean = float((rest[masks == 0].sum() + part[1] * none_clean) / clean_n)
            model.prior = float(np.clip(toxic_n / (toxic_n + clean_n), 1e-4, 0.5))
        if not len(masks):
            return
        post = model.posterior(masks)
        shared = np.zeros((VOTERS, VOTERS))  # within the classes, by their share
        for part_of, rate in ((post, model.hit_toxic), (1 - post, model.hit_clean)):
            total = part_of * counts
            rate = (total @ bits) / max(total.sum(), 1e-9)
            sd = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
            cov = (bits * total[:, None]).T @ bits / max(total.sum(), 1e-9) - np.outer(rate, rate)
            shared += total.sum() / counts.sum() * np.abs(cov / np.outer(sd, sd))
        np.fill_diagonal(shared, 0)
        model.correlation = np.clip(shared, 0, 1)
        model.weight = 1 / (1 + np.where(model.correlation > 0.1, model.correlation, 0).sum(axis=1))


def _clip(rate: np.ndarray) -> np.ndarray:
    return np.clip(rate, 1e-5, 1 - 1e-3)


def _classifier(model: Model, rows: DataFrame, wanted: np.ndarray, rounds: int = 400, ridge: float = 1e-4) -> None:
    """A logistic regression on the posteriors of the sample's documents."""
    wanted = np.sort(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            docs, codes = _terms(Words(block.column(1), ALNUM, lower=True))
            votes = model.votes(block.column(1), docs, codes)
            at = np.minimum(np.searchsorted(wanted, codes), max(0, len(wanted) - 1))
            found = wanted[at] == codes if len(wanted) else np.zeros(len(codes), dtype=bool)
            n = np.bincount(docs[found], minlength=block.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(at[found].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(votes), lists], ["mask", "f"])

    # At most ``sample`` rows with some of the chosen features each.
    table = rows.mapInArrow(run, "mask long, f array<int>").toArrow().combine_chunks()
    if not table.num_rows:
        model.bias = float(np.log(model.prior / (1 - model.prior)))
        return
    lists = table.column("f").combine_chunks()
    at = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    masks = table.column("mask").to_numpy()
    target, bits = model.posterior(masks), _bits(masks)
    n = len(target)
    w, v, b = np.zeros(len(wanted)), np.zeros(VOTERS), float(np.log(model.prior / (1 - model.prior)))
    past = [np.zeros_like(w), np.zeros_like(v), 0.0]
    square = [np.zeros_like(w), np.zeros_like(v), 0.0]
    for step in range(1, rounds + 1):
        error = (_sigmoid(np.bincount(row, w[at], minlength=n) + bits @ v + b) - target) / n
        grads = [np.bincount(at, error[row], minlength=len(wanted)) + ridge * w, error @ bits + ridge * v, error.sum()]
        new = []
        for i, (value, grad) in enumerate(zip((w, v, b), grads)):
            past[i] = 0.9 * past[i] + 0.1 * grad
            square[i] = 0.99 * square[i] + 0.01 * grad * grad
            new.append(value - 0.05 * (past[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-9))
        w, v, b = new
    model.features, model.feature_weights, model.vote_weights, model.bias = wanted, w, v, float(b)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with a score of each whole text, 0 to 1; null and empty texts get that of no word at all."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_col):
            yield block.append_column(out, pa.array(model.score(block.column(at))))

    if out in docs.columns:
        raise ValueError(f"docs already have a column {out}")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """docs without the rows that score ``threshold`` or more; their columns stay as they are."""
    out = "score"
    while out in docs.columns:
        out += "_"
    return score(docs, fit(docs, labels, **options), options.get("text_col", "text"), out).where(F.col(out) < threshold).drop(out)
