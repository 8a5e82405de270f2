"""Language of whole texts by a convolutional network over bytes, trained and applied in numpy.

Bytes are read as classes (letters without case, white space, digits, punctuation, each continuation byte, common lead
bytes). Filters of several widths slide over the embedded classes of a fixed-length window; each keeps its largest
response, and a softmax over these gives the window's languages. A text is cut into windows without gaps, so every byte
is read; its scores are the mean of its windows' scores, weighted by their bytes.

To apply a filter of fixed weights, the responses to each pair of classes are tabulated: a width of four is the sum of
two looked-up rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edaflux.llm.frames import map_rows

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
CLASSES = 128
BLOCK = 128
TEXTS = 3_000
WINDOWS_PER_TEXT = 6
_LEADS = (0xC2, 0xC3, 0xC4, 0xC5, 0xCE, 0xCF, 0xD0, 0xD1, 0xD7, 0xD8, 0xD9)


def byte_classes() -> np.ndarray:
    """Class of each byte; 0 is white space and padding."""
    table = np.full(256, 2, np.uint8)  # punctuation and control bytes
    table[[0x20, *range(0x09, 0x0E)]] = 0
    table[0x30:0x3A] = 1
    for k in range(26):
        table[0x41 + k] = table[0x61 + k] = 3 + k
    table[0x80:0xC0] = np.arange(29, 93)
    table[0xC0:0xE0], table[0xE0:0xF0], table[0xF0:] = 93, 94, 95
    for k, lead in enumerate(_LEADS):
        table[lead] = 96 + k
    return table


_CLASS = byte_classes()


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]  # one (width, embedding, filters) array for each width
    bias: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width its rows by pair of classes, and by single class for an odd last place."""
        out = []
        for w, b in zip(self.filters, self.bias, strict=True):
            single = [self.embedding @ w[j] for j in range(len(w))]
            rows = []
            for j in range(0, len(w) - 1, 2):
                rows.append((single[j][:, None] + single[j + 1][None]).reshape(-1, w.shape[2]))
            if len(w) % 2:
                rows.append(single[-1])
            rows[0] = rows[0] + b
            out.append([np.ascontiguousarray(r, np.float32) for r in rows])
        return out

    def window_scores(self, classes: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Logits of windows (rows of classes)."""
        out = np.empty((len(classes), len(self.languages)), np.float32)
        for a in range(0, len(classes), BLOCK):
            c = classes[a : a + BLOCK].astype(np.int32)
            pair = c[:, :-1] * CLASSES + c[:, 1:]
            best = []
            for w, rows in zip(self.filters, tables, strict=True):
                n = WINDOW - len(w) + 1
                response = rows[0].take(pair[:, :n], axis=0)
                for j in range(1, len(rows)):
                    at = 2 * j
                    response += rows[j].take(pair[:, at : at + n] if at < len(w) - 1 else c[:, at : at + n], axis=0)
                best.append(np.maximum(response.max(1), 0))
            out[a : a + BLOCK] = np.concatenate(best, 1) @ self.dense + self.offset
        return out

    def predict(self, texts: list[bytes | None], tables: list[list[np.ndarray]]) -> np.ndarray:
        """Probabilities of each text; empty and null texts have equal ones."""
        sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
        chance = np.full((len(texts), len(self.languages)), 1 / len(self.languages))
        full = np.flatnonzero(sizes)
        if not full.size:
            return chance
        size = sizes[full]
        windows = -(-size // WINDOW)
        classes = np.zeros(int(windows.sum()) * WINDOW, np.uint8)
        begin = (np.cumsum(windows) - windows) * WINDOW
        for i, b in zip(full.tolist(), begin.tolist(), strict=True):
            classes[b : b + len(texts[i])] = _CLASS[np.frombuffer(texts[i], np.uint8)]
        logits = self.window_scores(classes.reshape(-1, WINDOW), tables).astype(float)
        place = np.arange(len(logits)) - np.repeat(np.cumsum(windows) - windows, windows)
        weight = np.minimum(WINDOW, np.repeat(size, windows) - place * WINDOW)
        mean = np.add.reduceat(logits * weight[:, None], np.cumsum(windows) - windows, axis=0) / size[:, None]
        odds = np.exp(mean - mean.max(1, keepdims=True))
        chance[full] = odds / odds.sum(1, keepdims=True)
        return chance


def train(texts: list[bytes], languages: list[str], epochs: int = 5, batch: int = 64, rate: float = 0.004, seed: int = 3) -> Network:
    """A network trained by Adam on random windows of labelled texts, each language drawn as often as any other."""
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    windows, target = [], []
    for text, language in zip(texts, languages, strict=True):
        line = _CLASS[np.frombuffer(text, np.uint8)]
        for _ in range(min(WINDOWS_PER_TEXT, 1 + len(line) // WINDOW)):
            at = int(rng.integers(0, max(1, len(line) - WINDOW + 1)))
            part = line[at : at + (WINDOW if rng.random() < 0.7 else int(rng.integers(16, WINDOW)))]
            windows.append(np.pad(part, (0, WINDOW - len(part))))
            target.append(names.index(language))
    x, y = np.array(windows), np.array(target)
    share = 1 / np.bincount(y, minlength=len(names))[y]
    net = Network(
        names, rng.normal(0, 0.5, (CLASSES, EMBEDDING)),
        [rng.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS)) for w in WIDTHS], [np.zeros(FILTERS) for _ in WIDTHS],
        rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names))), np.zeros(len(names)),
    )
    held = [net.embedding, *net.filters, *net.bias, net.dense, net.offset]
    moment, square = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held]
    steps = epochs * max(1, len(x) // batch)
    for step in range(1, steps + 1):
        pick = rng.choice(len(x), min(batch, len(x)), p=share / share.sum())
        grads = _gradients(net, x[pick], y[pick])
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, s in zip(held, grads, moment, square, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross-entropy, by back-propagation through the largest responses."""
    tables = net.tables()
    c = x.astype(np.int32)
    pair = c[:, :-1] * CLASSES + c[:, 1:]
    best, where = [], []
    for w, rows in zip(net.filters, tables, strict=True):
        n = WINDOW - len(w) + 1
        response = rows[0].take(pair[:, :n], axis=0)
        for j in range(1, len(rows)):
            at = 2 * j
            response += rows[j].take(pair[:, at : at + n] if at < len(w) - 1 else c[:, at : at + n], axis=0)
        where.append(response.argmax(1))
        best.append(np.take_along_axis(response, where[-1][:, None], 1)[:, 0])
    pooled = np.concatenate(best, 1)
    active = np.maximum(pooled, 0)
    logits = active @ net.dense + net.offset
    odds = np.exp(logits - logits.max(1, keepdims=True))
    error = odds / odds.sum(1, keepdims=True)
    error[np.arange(len(y)), y] -= 1
    error /= len(y)
    back = (error @ net.dense.T) * (pooled > 0)
    d_embedding, d_filters, d_bias = np.zeros_like(net.embedding), [], []
    rows_ = np.arange(len(y))[:, None]
    for k, w in enumerate(net.filters):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        d = np.zeros_like(w)
        for j in range(len(w)):
            seen = c[rows_, where[k] + j]
            d[j] = np.einsum("bfe,bf->ef", net.embedding[seen], g)
            np.add.at(d_embedding, seen.ravel(), (g[:, :, None] * w[j].T[None]).reshape(-1, EMBEDDING))
        d_filters.append(d)
        d_bias.append(g.sum(0))
    return [d_embedding, *d_filters, *d_bias, active.T @ error, error.sum(0)]


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 3; null keys count as an empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(3))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", texts: int = TEXTS) -> Network | None:
    """Train on about ``texts`` texts, as many of each language as there are, outside the held-out fold.

    The sample holds the rows with small key hashes; the languages are counted over all rows. Null keys, texts and
    languages are never learnt from. Without any labelled text there is no network.
    """
    usable = docs.select(F.col(key).alias("k"), F.encode(text, "utf-8").alias("t"), F.col(lang).alias("l")).where(
        (fold(F.col("k")) != 1) & F.col("k").isNotNull() & F.col("l").isNotNull() & (F.octet_length("t") > 0)
    )
    counts = {r["l"]: r["count"] for r in usable.groupBy("l").count().collect()}
    if not counts:
        return None
    place = F.pmod(F.xxhash64("k", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    rates = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, texts / len(counts) / n))])
    rows = usable.where(place < rates[F.col("l")]).select("k", "t", "l").collect()
    rows.sort(key=lambda r: (r["k"], r["l"], r["t"]))
    return train([bytes(r["t"]) for r in rows], [r["l"] for r in rows])


def languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **sample: int) -> DataFrame:
    """Rows (key, held_out, lang_pred, score), one for each input row, from the whole of each text.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if there was nothing to learn from.
    Repeated rows and null keys stay.
    """
    net = fit(docs, key, text, lang, **sample)
    kind = docs.schema[key].dataType.simpleString()

    def work(rows: dict) -> dict:
        texts = rows["text"]
        known = [net is not None and t is not None and any(map(str.isalpha, t)) for t in texts]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if any(known):
            chance = net.predict([t.encode() if on else None for t, on in zip(texts, known, strict=True)], net.tables())
            for i, best in enumerate(chance.argmax(1).tolist()):
                if known[i]:
                    names[i], scores[i] = net.languages[best], float(chance[i, best])
        return {"key": rows["key"], "held_out": rows["held_out"], "lang_pred": names, "score": scores}

    picked = docs.select(F.col(key).alias("key"), (fold(F.col(key)) == 1).alias("held_out"), F.col(text).alias("text"))
    out = map_rows(picked, work, f"key {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("key", key)
