"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of each labelled language in the tasks and adds the counts up in a shuffle;
the log-probability matrix (buckets x languages) is broadcast, and batches of texts are scored as
sparse rows: their bucket numbers gather matrix rows, which are summed by document.  Scores cover
whole texts.

The model is fitted on a sample bounded by TRAIN_ROWS: rows are chosen by a 64-bit hash of id and
text so that about that many are expected (all, if there are no more).  The matrix has BUCKETS x languages cells; more labels
than `most_languages` (MOST_LANGUAGES by default) are an error, which bounds what is gathered and broadcast: raise it for more.

`accepted` uses the model in two ways.  A text's evidence is the mean over its n-grams of their
log-probability in the best language less that of a draw from all buckets alike; a text without more
evidence than EVIDENCE looks like none of the learned languages and is rejected.  With `languages`, so is a
text whose language isn't among those.

Edge cases: a text that is null or has no letter is `und` with score 0; without any labelled text
all are; equal scores go to the language first in order; null ids are told apart by their texts.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import CACHES, bounded_batches, enter, expected, trim

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
TRAIN_ROWS = 200_000
SMOOTHING = 0.1
#: Nats an n-gram by which a text has to be likelier in its language than among all buckets alike.
EVIDENCE = 0.0
#: Labels of a model at most: its matrix is 32 MiB then.
MOST_LANGUAGES = 256
#: Characters of a block of texts, and matrix cells gathered at a time.
BLOCK_CHARS, GATHERED = 1 << 17, 1 << 19
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """The code point itself for letters, a blank for the rest."""
    return np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), np.uint32, 0x110000)


CACHES["language"] = _letters.cache_clear


def _blocks(texts: list[str | None]):
    block, size = [], 0
    for text in texts:
        block.append((text or "").lower())
        size += len(block[-1])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def ngrams(texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(texts with a letter, for each order (bucket numbers, where each text's begin)); runs of other characters count as one blank."""
    flat = np.frombuffer("".join(" " + t for t in texts).encode("utf-32-le", "replace"), "<u4")
    codes = _letters()[flat]
    sizes = np.array([len(t) + 1 for t in texts])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    blank = codes == 32
    keep = ~(blank & np.concatenate([[False], blank[:-1]]))
    keep[begin] = True
    lettered = np.add.reduceat(~blank, begin, dtype=np.int64) > 0
    begin = (np.cumsum(keep) - 1)[begin]
    codes = codes[keep]
    end = np.append(begin[1:], len(codes))
    out = []
    for n in ORDERS:
        hashed = np.full(max(len(codes) - n + 1, 0), 0x9E3779B1 * n & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            hashed = (hashed ^ codes[i : len(hashed) + i]) * np.uint32(0x85EBCA6B)
            hashed ^= hashed >> np.uint32(13)
        buckets = ((hashed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)
        inside = np.ones(len(buckets), bool)
        for i in range(1, n):  # those that reach into the next text don't count
            at = end[:-1] - i
            inside[at[(at >= 0) & (at < len(inside))]] = False
        starts = np.concatenate([[0], np.cumsum(inside)])[np.minimum(begin, len(inside))]
        out.append((buckets[inside], starts))
    return lettered, out


def scores(texts: list[str], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts with a letter, summed log-probabilities of texts x languages, n-grams of each text)."""
    lettered, orders = ngrams(texts)
    grams = np.zeros(len(texts), np.int64)
    total, step = np.zeros((len(texts), matrix.shape[1])), max(1, GATHERED // max(1, matrix.shape[1]))
    for buckets, starts in orders:
        ends = np.append(starts[1:], len(buckets))
        grams += ends - starts
        for a in range(0, len(buckets), step):
            b = min(a + step, len(buckets))
            rows = np.flatnonzero((starts < b) & (ends > a) & (ends > starts))
            total[rows] += np.add.reduceat(matrix[buckets[a:b]], np.maximum(starts[rows], a) - a, axis=0, dtype=np.float64)
    return lettered, total, grams


def _count(batches):
    import pyarrow as pa

    enter("language")
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch["lang"].to_pylist())
        texts = batch["text"].to_pylist()
        for lang in np.unique(langs):
            held = counts.setdefault(str(lang), np.zeros(BUCKETS + 1, np.int64))
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            held[BUCKETS] += len(own)
            for block in _blocks(own):
                for buckets, _ in ngrams(block)[1]:
                    held[:BUCKETS] += np.bincount(buckets, minlength=BUCKETS)
    for lang, held in counts.items():
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(held[at])], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, most_languages: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """(languages, matrix) from rows where `learn` holds, text and language not null.

    What comes to the driver is the counts, BUCKETS + 1 a language at most.
    """
    bounded_batches(docs.sparkSession)
    usable = docs if learn is None else docs.where(learn)
    usable = usable.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    if usable.select(lang_col).distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"more than {most_languages} languages; most_languages allows more, at {BUCKETS * 4 >> 10} KiB of matrix each")
    usable = expected(usable, train_rows, usable.count(), "fit", id_col, text_col)
    rows = usable.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(_count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((BUCKETS + 1, len(langs)))
    counts[rows["bucket"].to_numpy(np.int64), np.searchsorted(np.array(langs, object), rows["lang"].to_numpy(object)) if langs else []] = rows["n"]
    grams, docs_of = counts[:BUCKETS] + SMOOTHING, counts[BUCKETS]
    matrix = np.log(grams / grams.sum(axis=0, keepdims=True)) if langs else np.zeros((BUCKETS, 0))
    prior = np.log(docs_of / docs_of.sum()) if langs else docs_of
    return langs, np.vstack([matrix, prior]).astype(np.float32)


def predict(texts: list[str | None], langs: list[str], matrix: np.ndarray, evidence: float | None = None) -> tuple[list[str], np.ndarray]:
    """(language, its posterior probability) of each text; with `evidence`, texts that have no more are unknown."""
    names, out = [], []
    for block in _blocks(texts):
        lettered, total, grams = scores(block, matrix[:BUCKETS])
        if not langs:
            names += [UNKNOWN] * len(block)
            out.append(np.zeros(len(block)))
            continue
        if evidence is not None:
            lettered &= total.max(axis=1) > (evidence - np.log(BUCKETS)) * grams
        total += matrix[BUCKETS]
        best = total.argmax(axis=1)
        posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        names += [langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
        out.append(np.where(lettered, posterior, 0.0))
    return names, np.concatenate(out) if out else np.zeros(0)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        enter("language")
        for batch in batches:
            names, score = predict(batch["text"].to_pylist(), *shared.value)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: tuple[list[str], np.ndarray], languages: frozenset[str] | None = None, evidence: float = EVIDENCE, text_col: str = "text") -> DataFrame:
    """docs, all columns, less the rows without letters, those that look like no learned language and, if `languages` is given, those in none of these.

    A model without languages knows letters only.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        enter("language")
        for batch in batches:
            texts = batch.column(at).to_pylist()
            names, _ = predict(texts, *shared.value, evidence)
            known = [n != UNKNOWN if shared.value[0] else any(map(str.isalpha, t or "")) for n, t in zip(names, texts)]
            yield batch.filter(pa.array([k and (languages is None or n in languages) for k, n in zip(known, names)], pa.bool_()))
        trim()

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether the CRC-32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
