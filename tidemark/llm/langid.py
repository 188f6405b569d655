"""Language identification in two steps: the family, then one-versus-one linear SVMs among its languages."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, pick, slices

#: Hashed byte n-grams that a text is described by.
DIMS = 2048
#: The classifiers are fitted on at most so many labelled documents of a language, and so many in all.
PER_LANGUAGE, SAMPLE = 1000, 6000
BLOCK = 512

#: Families of common languages by ISO 639-1 code; any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy lb af",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az uz kk ky tk",
    "indo-aryan": "hi bn ur mr ne gu pa",
    "semitic": "ar he mt am",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
#: ASCII bytes that aren't letters count as spaces; A-Z are lower-cased with the rest of the text.
LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def counts(data: bytes, dims: int = DIMS) -> np.ndarray:
    """Counts of hashed byte pairs and triples of all of ``data``, cut into chunks to bound memory."""
    out, step = np.zeros(dims), 1 << 20
    bits = np.uint32(32 - int(dims).bit_length() + 1)
    for at in range(0, max(len(data) - 1, 0), step):
        b = np.frombuffer(data, np.uint8, min(step + 2, len(data) - at), at).astype(np.uint32)
        two = b[:-1] << np.uint32(8) | b[1:]
        three = two[:-1] << np.uint32(8) | b[2:]
        out += np.bincount(((two[:step] + np.uint32(1 << 25)) * np.uint32(2654435761)) >> bits, minlength=dims)
        out += np.bincount((three[:step] * np.uint32(2654435761)) >> bits, minlength=dims)
    return out


def describe(text: str) -> np.ndarray:
    """Unit vector of square-rooted n-gram counts of a whole text, letters only."""
    x = np.sqrt(counts(text.lower().encode("utf-8", "surrogatepass").translate(LETTERS)))
    return (x / max(np.linalg.norm(x), 1e-12)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit_svm(x: np.ndarray, y: np.ndarray, seed: int = 42, epochs: int = 40, c: float = 50.0) -> np.ndarray:
    """Weights (bias last) of a linear SVM with squared hinge loss, classes balanced, by averaged mini-batch descent."""
    rng, n = np.random.default_rng(seed), len(y)
    x = np.c_[x, np.ones(n, np.float32)]
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    w, mean, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for e in range(epochs):
        for i in np.array_split(rng.permutation(n), max(1, n // 64)):
            gap = np.maximum(0, 1 - y[i] * (x[i] @ w)) * weight[i]
            w -= (w / c / n - 2 * (gap * y[i]) @ x[i] / len(i)) * (1.0 / (1 + e))
            if e >= epochs // 2:
                t += 1
                mean += (w - mean) / t
    return mean


class Hierarchy:
    """A linear SVM for each family against the rest, and one for each pair of languages of a family."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        self.langs = sorted(set(langs.tolist()))
        of = {k: FAMILY_OF.get(k.lower().split("-")[0], f"other-{k}") for k in self.langs}
        self.families = {f: [k for k in self.langs if of[k] == f] for f in dict.fromkeys(of.values())}
        own = np.array([of[k] for k in langs.tolist()])
        self.top = np.array([fit_svm(x, np.where(own == f, 1.0, -1.0)) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {}
        for members in self.families.values():
            for a, b in combinations(members, 2):
                two = (langs == a) | (langs == b)
                self.pairs[a, b] = fit_svm(x[two], np.where(langs[two] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row: the product of logistic transforms of the margins that decided."""
        x, names = np.c_[x, np.ones(len(x), np.float32)], list(self.families)
        sure = lambda margin: 1 / (1 + np.exp(-4 * np.clip(margin, -50, 50)))
        score, family = np.ones(len(x)), np.zeros(len(x), int)
        if self.top is not None:
            margins = x @ self.top.T
            family = margins.argmax(1)
            score = sure(np.sort(margins, 1)[:, -1])
        out = np.empty(len(x), object)
        for f, name in enumerate(names):
            rows, members = np.flatnonzero(family == f), self.families[name]
            votes, least = np.zeros((len(rows), len(members))), np.full((len(rows), len(members)), np.inf)
            for i, j in combinations(range(len(members)), 2):
                m = x[rows] @ self.pairs[members[i], members[j]]
                votes[:, i] += (m >= 0) + 1e-3 * np.tanh(m)
                votes[:, j] += (m < 0) - 1e-3 * np.tanh(m)
                least[:, i], least[:, j] = np.minimum(least[:, i], m), np.minimum(least[:, j], -m)
            best = votes.argmax(1)
            out[rows] = np.array(members, object)[best]
            if len(members) > 1:
                score[rows] *= sure(least[np.arange(len(rows)), best])
        return out.tolist(), score


def learn(docs: DataFrame, use, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Hierarchy | None:
    """Fit on rows where ``use`` holds and lang isn't null: PER_LANGUAGE of each language at most, by a hash of id and text.

    Only their descriptions come to the driver, ranked and cut by Spark. None if there is nothing to learn from.
    """
    rows = docs.where(use & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = pick(rows, id=id_col, text=text_col, lang=lang_col)
    n = dict(rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE).collect())
    if not n:
        return None
    most = max(1, min(PER_LANGUAGE, SAMPLE // len(n)))
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1.0, 1.2 * most / v + 1e-4))])
    h = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)) / float(1 << 40)
    chosen = rows.withColumn("h", h).where(F.col("h") <= F.element_at(share, F.col("lang")))

    def run(cols):
        return {"lang": cols["lang"], "h": cols["h"], "x": [describe(t.as_py()).astype(np.float16).tobytes() for t in cols["text"]]}

    own = Window.partitionBy("lang").orderBy("h", "x")
    got = arrow_map(chosen.select("lang", "h", "text"), run, "lang string, h double, x binary")
    got = got.withColumn("k", F.row_number().over(own)).where(F.col("k") <= most).drop("k").toArrow().to_pandas().sort_values(["lang", "h", "x"])
    if not len(got):
        return None
    x = np.stack([np.frombuffer(b, np.float16) for b in got["x"]]).astype(np.float32)
    return Hierarchy(x, got["lang"].to_numpy(object))


def identify(docs: DataFrame, model: Hierarchy | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row: ``und`` with score 1 where text is null or has no letter, or without model.

    The model is a few weight vectors, broadcast; every text is read whole. Repeated rows get the same answer.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(cols):
        langs, scores = [], []
        for at in range(0, len(cols["text"]), BLOCK):
            texts = cols["text"].slice(at, BLOCK).to_pylist()
            own = [i for i, t in enumerate(texts) if shared.value is not None and has_letter(t)]
            lang, score = ["und"] * len(texts), np.ones(len(texts))
            if own:
                names, sure = shared.value.predict(np.stack([describe(texts[i]) for i in own]))
                score[own] = sure
                for i, k in zip(own, names, strict=True):
                    lang[i] = k
            langs += lang
            scores.append(score)
        return {"id": cols["id"], "lang_pred": pa.array(langs, pa.string()), "score": np.concatenate(scores)}

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(pick(docs, id=id_col, text=text_col), run, f"id {kind}, lang_pred string, score double")


def with_language(docs: DataFrame, model: Hierarchy | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.3) -> DataFrame:
    """``docs`` with the predicted language in ``lang_col``, without rows that are ``und`` or score below ``least``.

    One pass over the rows with all their columns; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, lang = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches):
        for b in batches:
            for part in slices(b, text_col):
                texts = part.column(text).to_pylist()
                own = [i for i, t in enumerate(texts) if shared.value is not None and has_letter(t)]
                if not own:
                    continue
                names, sure = shared.value.predict(np.stack([describe(texts[i]) for i in own]))
                good = [(i, k) for i, k, s in zip(own, names, sure, strict=True) if s >= least]
                part = part.take(pa.array([i for i, _ in good], pa.int64()))
                cols = [pa.array([k for _, k in good], pa.string()) if k == lang else part.column(k) for k in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays(cols, part.schema.names)

    return docs.mapInArrow(run, docs.schema)
