"""Language ID by a byte convolutional network, trained in numpy.

A text's UTF-8 bytes are cut into windows of fixed length that cover it whole. Each byte has an
embedding; filters of several widths run over a window, the largest response of each filter over
the window is kept, and a softmax layer gives language probabilities. A text's probabilities are
the mean over its windows, weighted by their bytes.
"""

from __future__ import annotations

import base64
import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, free_names, map_texts

NAME = "op10_language_id"
ORACLE_SQL = None  # a trained network; tests measure held-out accuracy

#: Largest number of labelled rows that the classifier is fitted on: of each language in turn the one of lowest hash of doc_id.
TRAIN_ROWS = 3000
#: Windows of a training row, spread evenly over its text.
TRAIN_WINDOWS = 4
#: Bytes of a window.
WINDOW = 192
EMBED, WIDTHS, FILTERS = 8, (2, 3, 4, 5), 16
EPOCHS, BATCH, RATE, SEED = 6, 64, 3e-3, 11
UNDETERMINED = "und"
#: The pipeline rejects texts without letters, and those whose best language has less than this probability.
MIN_SCORE = 0.3


def windows(data: bytes, size: int = WINDOW) -> np.ndarray:
    """All windows of a text, [n, size] bytes; the last one is moved back to end with the text, a short text is padded by zeros."""
    a = np.frombuffer(data, dtype=np.uint8)
    if len(a) <= size:
        out = np.zeros((1, size), dtype=np.uint8)
        out[0, : len(a)] = a
        return out
    full = len(a) // size
    out = a[: full * size].reshape(full, size)
    if len(a) % size:
        out = np.concatenate([out, a[-size:].reshape(1, size)])
    return out


class ByteConvNet:
    """Embedding, convolutions of several widths, max pooling over positions, softmax."""

    def __init__(self, classes: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.classes = list(classes)
        p = self.params = {"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            p[f"conv{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
            p[f"bias{w}"] = np.zeros(FILTERS, np.float32)
        p["out"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))).astype(np.float32)
        p["out_bias"] = np.zeros(len(classes), np.float32)

    def _stretches(self, x: np.ndarray, w: int) -> np.ndarray:
        """[n, positions, w * EMBED] view of embedded windows."""
        n, size, _ = x.shape
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, size - w + 1, w * EMBED), (s[0], s[1], s[2]))

    def _pooled(self, batch: np.ndarray, grads: bool = False):
        p = self.params
        x = np.ascontiguousarray(p["embed"][batch])
        pooled, kept = [], []
        for w in WIDTHS:
            view = self._stretches(x, w)
            n, positions, width = view.shape
            flat = view.reshape(n * positions, width)
            out = (flat @ p[f"conv{w}"]).reshape(n, positions, FILTERS)
            if grads:
                where = out.argmax(1)
                kept.append((flat.reshape(n, positions, width), where))
            pooled.append(np.maximum(out.max(1) + p[f"bias{w}"], 0))
        return np.concatenate(pooled, 1), kept

    def probabilities(self, batch: np.ndarray) -> np.ndarray:
        hidden, _ = self._pooled(batch)
        z = hidden @ self.params["out"] + self.params["out_bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def _gradients(self, batch: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        p = self.params
        hidden, kept = self._pooled(batch, grads=True)
        z = hidden @ p["out"] + p["out_bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(target)), target] -= 1
        z /= len(target)
        g = {"out": hidden.T @ z, "out_bias": z.sum(0), "embed": np.zeros_like(p["embed"])}
        down = (z @ p["out"].T) * (hidden > 0)
        rows = np.arange(len(batch))[:, None]
        for k, w in enumerate(WIDTHS):
            view, where = kept[k]
            d = down[:, k * FILTERS : (k + 1) * FILTERS]
            picked = view[rows, where]  # [n, FILTERS, w * EMBED]
            g[f"conv{w}"] = np.einsum("nfi,nf->if", picked, d)
            g[f"bias{w}"] = d.sum(0)
            back = (d[:, :, None] * p[f"conv{w}"].T[None]).reshape(len(batch), FILTERS, w, EMBED)
            for j in range(w):
                np.add.at(g["embed"], batch[rows, where + j].ravel(), back[:, :, j].reshape(-1, EMBED))
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> ByteConvNet:
        """Adam on mini-batches of windows; deterministic for given data and seed."""
        rng = np.random.default_rng(seed)
        moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.params.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                step += 1
                for k, g in self._gradients(x[part], y[part]).items():
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.params[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def predict_texts(self, texts: list[str | None], rows: int = 64) -> list[tuple[str, float]]:
        """Per text its language and probability; `und` with 0.0 if it has no letter."""
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        total = np.zeros((len(texts), max(1, len(self.classes))))
        weight = np.zeros(len(texts))
        waiting: list[np.ndarray] = []
        owners: list[tuple[int, int]] = []
        held = 0

        def flush():
            nonlocal held
            if not waiting:
                return
            x = np.concatenate(waiting)
            owner = np.concatenate([np.full(n, i) for i, n in owners])
            used = np.count_nonzero(x, axis=1).astype(float)
            for at in range(0, len(x), rows):
                p = self.probabilities(x[at : at + rows])
                np.add.at(total, owner[at : at + rows], p * used[at : at + rows, None])
                np.add.at(weight, owner[at : at + rows], used[at : at + rows])
            waiting.clear()
            owners.clear()
            held = 0

        letters = [bool(self.classes) and bool(t) and has_letter(t) for t in texts]
        for i, text in enumerate(texts):
            if not letters[i]:
                continue
            data = text.encode("utf-8")
            for at in range(0, len(data), WINDOW * 1024):  # very long texts in pieces
                x = windows(data[at : at + WINDOW * 1024])
                waiting.append(x)
                owners.append((i, len(x)))
                held += len(x)
                if held >= 2048:
                    flush()
        flush()
        for i, has in enumerate(letters):
            if has:
                share = total[i] / max(weight[i], 1e-12)
                best = int(share.argmax())
                out[i] = (self.classes[best], float(min(1.0, max(0.0, share[best]))))
        return out

    def dump(self) -> str:
        buffer = io.BytesIO()
        np.savez(buffer, classes=np.array(self.classes, dtype=str), **self.params)
        return base64.b64encode(buffer.getvalue()).decode()

    @classmethod
    def load(cls, text: str) -> ByteConvNet:
        with np.load(io.BytesIO(base64.b64decode(text))) as z:
            net = cls([str(c) for c in z["classes"]])
            net.params = {k: z[k] for k in z.files if k != "classes"}
        return net


def has_letter(text: str) -> bool:
    """Whether any character is of a letter category."""
    return any(map(str.isalpha, text))


def held_out() -> F.Column:
    """Whether crc32 of doc_id as text leaves 2 when divided by 4; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def train(df: DataFrame, rows: int = TRAIN_ROWS, seed: int = SEED) -> ByteConvNet:
    """Fit on at most `rows` labelled rows that are not held out, the same ones in every run.

    Languages take turns, so that a rare one is learned too as long as there are no more languages
    than rows. Only the chosen rows' windows come to the driver; rows without a doc_id are never
    chosen, and of rows that share doc_id and language one is. Without labelled rows the network has
    no classes and every prediction is `und`.
    """
    labelled = df.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    drawn = labelled.select("doc_id", "lang", F.xxhash64(F.lit(seed), "doc_id").alias("draw")).distinct()
    # A bounded number of each language is kept before rows meet.
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    ranked = drawn.withColumn("turn", turn).filter(F.col("turn") <= rows)
    chosen = ranked.orderBy("turn", "lang").limit(rows).select(F.col("doc_id").alias("_d"), F.col("lang").alias("_l"))

    def cut(texts: list[str | None]) -> dict[str, list]:
        found = []
        for text in texts:
            x = windows((text or "").encode("utf-8"))
            pick = np.unique(np.linspace(0, len(x) - 1, TRAIN_WINDOWS).astype(int))
            found.append([x[i].tobytes() for i in pick])
        return {"cut": found}

    # bounded by `rows`
    sample = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), (F.col("doc_id") == F.col("_d")) & (F.col("lang") == F.col("_l")), "left_semi")
    cuts = map_texts(sample, cut, "cut array<binary>", keep=("doc_id", "lang")).groupBy("doc_id", "lang").agg(F.min("cut").alias("cut"))
    got = sorted((r.doc_id, r.lang, tuple(map(bytes, r.cut))) for r in cuts.collect())
    classes = sorted({lang for _, lang, _ in got})
    net = ByteConvNet(classes, seed)
    if len(classes) < 1:
        return net
    x = np.frombuffer(b"".join(w for _, _, ws in got for w in ws), dtype=np.uint8).reshape(-1, WINDOW)
    y = np.array([classes.index(lang) for _, lang, ws in got for _ in ws])
    return net.fit(x, y, seed=seed)


_nets: dict[int, ByteConvNet] = {}


def identify(df: DataFrame, net: ByteConvNet, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the columns `keep`, held_out, lang_pred, score; every whole text is read.

    A null text or one without a letter gives `und` and score 0.0. Only the text is an input of the
    prediction; repeated rows give repeated results and other columns are ignored.
    """
    model = net.dump()

    def work(texts: list[str | None]) -> dict[str, list]:
        key = hash(model)
        if key not in _nets:
            _nets.clear()
            _nets[key] = ByteConvNet.load(model)
        told = _nets[key].predict_texts(texts)
        return {"lang_pred": [a for a, _ in told], "score": [b for _, b in told]}

    names = [f"_k{i}" for i in range(len(keep))]  # kept columns may be named like the new ones
    shown = df.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), held_out().alias("held_out"), F.col("text").alias("_text_in"))
    text = names[keep.index("text")] if "text" in keep else "_text_in"
    told = map_texts(shown, work, "lang_pred string, score double", text, (*names, "held_out"))
    return told.withColumnsRenamed(dict(zip(names, keep, strict=True)))


def recognised(df: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """The rows of df, with its columns, whose language is recognised with at least this probability.

    The network learns from df's own labelled rows; without any, all rows with a letter stay. Rows
    without a letter (null, empty) go; repeated rows and null ids are decided row by row; columns of
    any name are kept as they are, and an empty table gives no rows.
    """
    net = train(df)
    if not net.classes:
        return df.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    told = identify(df, net, tuple(df.columns))
    # by position: kept columns come first and may be named like the new ones
    names = free_names(df, "_held_out", "_pred", "_score")
    told = told.toDF(*df.columns, *names)
    return told.filter((F.col(names[1]) != UNDETERMINED) & (F.col(names[2]) >= least)).select(*[F.col(f"`{c}`") for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir)
    return identify(df, train(df))
