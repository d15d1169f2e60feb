"""Language identification as a mixture: each document's shares of the learned languages.

Letter trigrams, hashed into a fixed number of cells, give every word a likelihood under each
language.  Expectation-maximisation over a document's words estimates its language proportions; the
set of languages is the one whose likelihood, less a penalty for each language, is highest.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType

from .store import bounded_batches

CELLS = 1 << 15
UNKNOWN = "und"
_SLAB = 1 << 18  # code points in one array pass
_GAP = re.compile(r"[ \n]")


@dataclass(frozen=True)
class Limits:
    """Bounds of the fit, whatever the input's size; the model has a column for each labelled language."""

    docs_per_language: int = 3000  # labelled documents that the model learns from, by smallest hash


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_p: np.ndarray  # cells x languages
    penalty: float = 3.0  # nats for each language after the first
    floor: float = -14.0


_lower: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or 0 for anything but a letter."""
    global _lower
    if _lower is None:
        table = np.zeros(sys.maxunicode + 1, np.uint32)
        for c in range(sys.maxunicode + 1):
            if (s := chr(c)).isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _lower = table
    return _lower


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a text's letter trigrams with word borders, and where each word's cells begin."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    line = np.zeros(len(points) + 3, np.uint32)
    line[2:-1] = _letters()[points]
    at = np.flatnonzero((line[2:] > 0) | (line[1:-1] > 0)) + 2  # each letter, and the border after a word
    before = np.where(line[at - 1] == 0, np.uint32(0), line[at - 2])  # words do not see each other
    h = before * np.uint32(0x9E3779B1) ^ line[at - 1] * np.uint32(0x85EBCA6B) ^ line[at] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    begins = np.flatnonzero((line[at - 1] == 0) & (line[at] > 0))
    return ((h * np.uint32(0x27D4EB2F)) >> np.uint32(17)).astype(np.int64), begins


def _pieces(text: str) -> Iterator[str]:
    """A long text in slabs that end at white space; a word longer than a slab stays whole."""
    at = 0
    while at < len(text):
        end = min(len(text), at + _SLAB)
        if end < len(text):
            cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = cut + 1 if cut > at else m.end() if (m := _GAP.search(text, end)) else len(text)
        yield text[at:end]
        at = end


def training_rows(docs: DataFrame, learn: Column, limits: Limits, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """The bounded sample of labelled rows: per language those with a hash below a share, of the id or else of the text.

    The share comes from the counts of all labelled rows; every language is learned.  Only narrow
    columns are read for the counts.
    """
    known = docs.where(learn & F.col(lang_col).isNotNull())
    share = F.least(F.lit(1.0), F.lit(limits.docs_per_language) / F.count("*"))
    shares = known.groupBy(F.col(lang_col).alias("_l")).agg(share.alias("_share"))  # a row for each language
    own = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(1), F.col(text_col))).otherwise(F.xxhash64(F.col(id_col).cast("string")))
    roll = F.pmod(own, F.lit(1 << 20))
    rows = known.join(F.broadcast(shares), known[lang_col] == F.col("_l"))
    return rows.where(roll < (F.col("_share") * (1 << 20)).cast("long") + 1).select(*[known[c] for c in known.columns])


def fit(docs: DataFrame, learn: Column | None = None, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn trigram likelihoods from the rows for which ``learn`` holds and the language is known.

    Tasks count cells; only the cells of each language (a table of cells x languages) reach the driver.
    """
    bounded_batches(docs.sparkSession)
    learn = F.lit(True) if learn is None else learn
    rows = training_rows(docs, learn, limits, id_col, text_col, lang_col).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))

    def cells_of(found: dict[str, np.ndarray]) -> pd.DataFrame:
        return pd.concat([pd.DataFrame({"lang": lang, "cell": (at := np.flatnonzero(total)), "n": total[at].astype(np.int64)}) for lang, total in found.items()])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                if lang not in found and len(found) == 64:  # no task holds tables of all languages
                    yield cells_of(found)
                    found.clear()
                total = found.setdefault(lang, np.zeros(CELLS))
                for piece in _pieces(text or ""):
                    total += np.bincount(trigrams(piece)[0], minlength=CELLS)
        if found:
            yield cells_of(found)

    counts = rows.mapInPandas(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((CELLS, len(langs)))
    table[counts["cell"].to_numpy(), pd.Categorical(counts["lang"], categories=langs).codes] = counts["n"].to_numpy()
    smooth = table + 0.5
    return Model(langs, np.log(smooth / smooth.sum(0)).astype(np.float32))


def _em(like: np.ndarray, doc: np.ndarray, begins: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Mixture shares and log-likelihoods of documents whose words' likelihoods are in ``like``."""
    n = np.diff(np.append(begins, len(like)))[:, None]
    for _ in range(rounds):
        joint = like * share[doc]
        joint /= joint.sum(1, keepdims=True)
        share = np.add.reduceat(joint, begins) / n
    return share, np.add.reduceat(np.log((like * share[doc]).sum(1)), begins)


def infer(words: np.ndarray, begins: np.ndarray, model: Model, rounds: int = 15) -> np.ndarray:
    """Language shares of each document; ``words`` has a row of log-likelihoods for each word.

    Sets of one, two and more languages compete, each the largest shares of the full mixture, until no
    larger set can win.
    """
    n_lang = words.shape[1]
    sizes = np.diff(np.append(begins, len(words)))
    doc = np.repeat(np.arange(len(begins)), sizes)
    top = words.max(1)
    like = np.exp(np.maximum(words - top[:, None], model.floor)).astype(np.float64)
    single = np.add.reduceat(np.log(like), begins)  # per language, less base
    best = single.max(1)
    out = np.eye(n_lang)[single.argmax(1)]
    if n_lang == 1:
        return out
    full, whole = _em(like, doc, begins, np.full((len(begins), n_lang), 1.0 / n_lang), rounds)
    for k in range(2, n_lang + 1):
        # the full mixture bounds any set's likelihood: only documents that could gain are fitted again
        ask = np.flatnonzero(whole - model.penalty * (k - 1) > best)
        if not len(ask):
            break
        rows = np.flatnonzero(np.isin(doc, ask))
        again = np.repeat(np.arange(len(ask)), sizes[ask])
        cut = np.sort(full[ask], axis=1)[:, -k][:, None]
        start = np.where(full[ask] >= cut, full[ask], 0) + 0.0
        start /= start.sum(1, keepdims=True)
        share, value = _em(like[rows], again, np.concatenate(([0], np.cumsum(sizes[ask])[:-1])), start, rounds)
        value = value - model.penalty * (k - 1)
        won = value > best[ask]
        best[ask[won]] = value[won]
        out[ask[won]] = share[won]
    return out


def _word_scores(text: str, model: Model) -> np.ndarray:
    parts = []
    for piece in _pieces(text):
        cells, begins = trigrams(piece)
        if len(begins):
            parts.append(np.add.reduceat(model.log_p[cells[begins[0] :]], begins - begins[0]))
    return np.concatenate(parts) if parts else np.zeros((0, len(model.languages)), np.float32)


def predict(texts: list[str | None], model: Model) -> list[tuple[str, float, dict[str, float]]]:
    """(language, its share, all shares) of each text; ``und`` and 0 for texts without a letter."""
    out: list[tuple[str, float, dict[str, float]]] = [(UNKNOWN, 0.0, {})] * len(texts)
    if not model.languages:
        return out
    held: list[tuple[int, np.ndarray]] = []
    waiting = 0

    def settle() -> None:
        if held:
            begins = np.concatenate(([0], np.cumsum([len(w) for _, w in held])[:-1])).astype(np.int64)
            for (i, _), share in zip(held, infer(np.concatenate([w for _, w in held]), begins, model), strict=True):
                best = int(share.argmax())
                out[i] = model.languages[best], float(min(1.0, share[best])), {model.languages[j]: float(s) for j, s in enumerate(share) if s > 0.001}
            held.clear()

    for i, text in enumerate(texts):
        scores = _word_scores(text or "", model)
        if len(scores):
            held.append((i, scores))
            waiting += len(scores)
        if waiting * len(model.languages) > 1 << 19:
            settle()
            waiting = 0
    settle()
    return out


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id_col (or the columns ``keep``), lang_pred, score and shares (language -> share) of every row.

    Null, empty and letterless texts give ``und`` with score 0, as does a model without languages.
    Only the text is an input of the prediction.  Repeated rows stay.
    """
    bounded_batches(docs.sparkSession)
    keep = keep or [id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # cells x languages
    schema = StructType([docs.schema[c] for c in keep] + [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("shares", MapType(StringType(), DoubleType()))])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = predict(b.column(len(keep)).to_pylist(), shared.value)
            columns = [b.column(i) for i in range(len(keep))]
            columns += [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            columns.append(pa.array([list(x[2].items()) for x in found], pa.map_(pa.string(), pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias("_text")).mapInArrow(run, schema)
