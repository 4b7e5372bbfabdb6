"""Languages of documents and of the one-language segments of mixed texts (problem 5).

A bidirectional gated recurrent network over bytes, trained here in numpy by backpropagation through time, gives every
byte position a probability of each language. The positions of a sentence are pooled, the sentences weigh by their letters,
and a document is of the language most of its letters are in, or mixed if two languages each have enough of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.session import spread

LANGUAGES = ("en", "ar", "fr", "de", "es", "fa", "hi", "zh", "ja", "th")
MIXED = "mixed"
#: Longest stretch of bytes that the network sees at once; longer sentences are cut into such stretches.
STRETCH = 96
#: What becomes a blank: numbers and any signs but letters, apostrophes, hyphens and what ends a sentence.
SIGNS = regex.compile(r"(?:\p{Nd}+(?:[.,:/٫٬]\p{Nd}+)*|[^\p{L}\p{M}\p{Nd}'’\u200c\-\n.!?؟。！？।…])+")
END = re.compile(r"[\n!?؟。！？।….](?:(?<!\.)|(?=\s|$))")
NUMBER = re.compile(r"\d\d*(?:[.,:/٫٬]\d+)*")
BLANKS = re.compile("   *")
BEYOND = re.compile("[\U00010000-\U0010ffff]")
#: As SIGNS without numbers and blanks, for texts of the first plane: there a set is looked up in a table.
PLAIN_SIGNS = re.compile("[" + re.escape("".join(regex.findall(r"[^\p{L}\p{M}\p{Nd}'’\u200c\-\n.!?؟。！？।…]", "".join(chr(c) for c in range(0x10000) if c != 0x20 and not 0xD800 <= c <= 0xDFFF)))) + "]+")


def reduced(text: str) -> str:
    """The text with numbers and signs as one blank."""
    return SIGNS.sub(" ", text) if BEYOND.search(text) else BLANKS.sub(" ", PLAIN_SIGNS.sub(" ", NUMBER.sub(" ", text)))


def sentences_of(text: str) -> list[str]:
    """The sentences of a text in the form that the network reads: letters in lower case, any other signs as one blank.

    For pooling only: exact units come from ``wardloom.llm.sentences``.
    """
    return [k for s in END.split(reduced(text).lower()) if (k := s.strip(" .'’-"))]


class ByteGru:
    """Gated recurrent units over bytes in both directions, with a softmax over languages at every position."""

    def __init__(self, hidden: int = 20, classes: int = len(LANGUAGES), seed: int = 5):
        r = np.random.default_rng(seed)
        self.hidden = hidden
        w = lambda *s: (r.standard_normal(s) * 0.2).astype("float32")
        u = lambda: np.concatenate([np.linalg.qr(r.standard_normal((hidden, hidden)))[0] for _ in range(3)], 1).astype("float32")
        self.p = {"xf": w(256, 3 * hidden), "uf": u(), "xb": w(256, 3 * hidden), "ub": u(), "o": w(2 * hidden, classes), "c": np.zeros(classes, "float32")}

    def run(self, x: np.ndarray, back: bool) -> tuple[np.ndarray, list]:
        """States after each byte as (positions, units, texts); x is (positions, texts), 0 where a text is over."""
        w, u, n = self.p["xb" if back else "xf"].T.copy(), self.p["ub" if back else "uf"].T.copy(), self.hidden
        steps, batch = x.shape
        h, out, kept = np.zeros((n, batch), "float32"), np.empty((steps, n, batch), "float32"), []
        live = (x > 0).astype("float32")[:, None]
        for t in range(steps - 1, -1, -1) if back else range(steps):
            a, g = np.take(w, x[t], axis=1, mode="clip"), u @ h
            zr = 1 / (1 + np.exp(-(a[: 2 * n] + g[: 2 * n])))
            z, r = zr[:n], zr[n:]
            c = np.tanh(a[2 * n :] + r * g[2 * n :])
            new = h + live[t] * (1 - z) * (c - h)
            kept.append((t, h, z, r, c, g[2 * n :]))
            h = out[t] = new
        return out, kept

    def logits(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """(positions, languages, texts)"""
        f, kf = self.run(x, False)
        b, kb = self.run(x, True)
        s = np.concatenate([f, b], 1)
        return self.p["o"].T @ s + self.p["c"][:, None], (s, kf, kb)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """As the softmax of ``logits``, with nothing kept for a gradient: sigmoids and tangents by one exponential each, in place."""
        n, (steps, batch) = self.hidden, x.shape
        # units by texts, so that every operation goes over whole rows of texts
        states, live = np.empty((steps, 2 * n, batch), "float32"), (x > 0).astype("float32")[:, None]
        whole = bool(live.all())
        a = np.empty((3 * n, batch), self.p["xf"].dtype)
        g, zr, c = (np.empty((k * n, batch), "float32") for k in (3, 2, 1))
        with np.errstate(over="ignore"):
            for d, part in (("f", states[:, :n]), ("b", states[:, n:])):
                w, u, h = self.p["x" + d].T.copy(), self.p["u" + d].T.copy(), np.zeros((n, batch), "float32")
                w[: 2 * n] *= -1
                u[: 2 * n] *= -1
                for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                    np.matmul(u, h, out=g)
                    np.take(w, x[t], axis=1, out=a, mode="clip")
                    np.add(a[: 2 * n], g[: 2 * n], out=zr)
                    np.exp(zr, out=zr)
                    zr += 1
                    np.reciprocal(zr, out=zr)
                    np.multiply(zr[n:], g[2 * n :], out=c)
                    c += a[2 * n :]
                    c *= 2
                    np.exp(c, out=c)
                    c += 1
                    np.reciprocal(c, out=c)
                    c *= -2
                    c += 1
                    c -= h
                    np.subtract(1, zr[:n], out=zr[:n])
                    c *= zr[:n]
                    if not whole:
                        c *= live[t]
                    h += c
                    part[t] = h
        y = np.matmul(self.p["o"].T, states)
        y += self.p["c"][:, None]
        y -= y.max(1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(1, keepdims=True)
        return y.transpose(0, 2, 1)

    def gradient(self, x: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        y, (s, kf, kb) = self.logits(x)
        e = np.exp(y - y.max(1, keepdims=True))
        d = e / e.sum(1, keepdims=True)
        d[:, label, np.arange(len(label))] -= 1
        d *= ((x > 0) / max(1, (x > 0).sum())).astype("float32")[:, None]
        rows = lambda v: v.transpose(1, 0, 2).reshape(v.shape[1], -1)
        out = {"o": rows(s) @ rows(d).T, "c": d.sum((0, 2))}
        ds, n = self.p["o"] @ d, self.hidden
        for name, kept, part in (("f", kf, ds[:, :n]), ("b", kb, ds[:, n:])):
            u, gx = self.p["u" + name], np.zeros_like(self.p["x" + name])
            at = np.array([k[0] for k in kept])
            h, z, r, c, gc = (np.stack([k[i] for k in kept]) for i in range(1, 6))
            live = (x[at] > 0).astype("float32")[:, None]
            # what the gradient of a state is multiplied by, for all positions at once
            to_z, to_pre, to_r, stays = live * (h - c) * z * (1 - z), live * (1 - z) * (1 - c * c), gc * r * (1 - r), 1 - live * (1 - z)
            dg = np.empty((len(kept), 3 * n, x.shape[1]), "float32")
            da = np.empty_like(dg)
            back = np.zeros((n, x.shape[1]), "float32")
            for k in range(len(kept) - 1, -1, -1):
                dh = back + part[at[k]]
                np.multiply(dh, to_z[k], out=dg[k, :n])
                dpre = np.multiply(dh, to_pre[k], out=da[k, 2 * n :])
                np.multiply(dpre, to_r[k], out=dg[k, n : 2 * n])
                np.multiply(dpre, r[k], out=dg[k, 2 * n :])
                back = dh * stays[k] + u @ dg[k]
            da[:, : 2 * n] = dg[:, : 2 * n]
            owner = x[at].ravel()
            order = np.argsort(owner, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(owner[order]) != 0])
            gx[owner[order[first]]] = np.add.reduceat(da.transpose(0, 2, 1).reshape(-1, 3 * n)[order], first)
            out["u" + name], out["x" + name] = rows(h) @ rows(dg).T, gx
        return out

    def train(self, texts: list[bytes], labels: np.ndarray, steps: int = 260, batch: int = 128, rate: float = 0.012, seed: int = 9) -> None:
        """Adam on stretches from anywhere in the texts, every language as often."""
        r = np.random.default_rng(seed)
        own = [np.flatnonzero(labels == k) for k in range(len(LANGUAGES))]
        own = [o for o in own if len(o)]
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            pick = np.array([r.choice(own[j]) for j in r.integers(0, len(own), batch)])
            size = int(r.choice([12, 24, 48, 72]))
            at = [int(r.integers(0, max(1, len(texts[i]) - size + 1))) for i in pick]
            x = packed_bytes([texts[i][a : a + size] for i, a in zip(pick, at)])
            for k, g in self.gradient(x, labels[pick]).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= (rate * min(1, 3 * (1 - t / (steps + 1))) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype("float32")


def packed_bytes(texts: list[bytes]) -> np.ndarray:
    x = np.zeros((max(map(len, texts), default=1) or 1, len(texts)), "int64")
    for j, t in enumerate(texts):
        x[: len(t), j] = np.frombuffer(t, "uint8")
    return x


class Labeler:
    """Languages of sentences by a trained network; sentences that were seen shortly before aren't run again."""

    def __init__(self, net: ByteGru):
        self.net = net
        self.seen: dict[str, int] = {}
        self.known = np.zeros((0, len(LANGUAGES)), "float32")

    def evidence(self, keys: list[str]) -> np.ndarray:
        """Sum over the positions of each sentence of the log probability of each language."""
        new = list(dict.fromkeys(k for k in keys if k not in self.seen))
        if len(self.seen) + len(new) > 400_000:
            self.seen.clear()
            self.known = self.known[:0]
            new = list(dict.fromkeys(keys))
        first = len(self.known)
        self.seen.update(zip(new, range(first, first + len(new))))
        stretches = [(j, b[i : i + STRETCH]) for j, k in enumerate(new) for b in (k.encode("utf-8", "replace"),) for i in range(0, max(1, len(b)), STRETCH)]
        stretches.sort(key=lambda x: len(x[1]))
        found = np.zeros((len(new), len(LANGUAGES)), "float32")
        for i in range(0, len(stretches), 512):
            part = stretches[i : i + 512]
            x = packed_bytes([b for _, b in part])
            np.add.at(found, [j for j, _ in part], (np.log(self.net.probabilities(x) + np.float32(1e-4)) * (x > 0)[..., None]).sum(0))
        if new:
            self.known = np.concatenate([self.known, found])
        return self.known[np.fromiter(map(self.seen.__getitem__, keys), "int64", len(keys))]


_KEPT: dict[int, Labeler] = {}


def labeler(net: ByteGru) -> Labeler:
    """One labeler for all tasks of a Python worker, as long as the network is the same."""
    k = hash(net.p["o"].tobytes())
    if k not in _KEPT:
        _KEPT.clear()
        _KEPT[k] = Labeler(net)
    return _KEPT[k]


def trained(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = 250) -> ByteGru:
    """A network fitted on about ``per_language`` documents of each label, chosen by a hash of their ids; nothing else is sampled.

    Labels may be wrong: the network is fitted, then fitted on without the texts whose label it doesn't share.
    """
    src = docs.where(F.col(label).isin(*LANGUAGES) & F.col(text).isNotNull())
    counts = {r[0]: r.n for r in src.groupBy(label).agg(F.count("*").alias("n")).collect()}  # ten languages at most
    if not counts:
        raise ValueError("no document has a label to learn from")
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    picked = (F.pmod(F.xxhash64(F.col(doc_id), F.lit(7)), F.lit(1_000_003)) / 1_000_003) < share[F.col(label)]
    rows = src.where(picked).select(F.col(label).alias("l"), F.col(text).alias("t")).orderBy("l", F.xxhash64("t")).collect()  # about per_language x 10
    texts = [" ".join(sentences_of(r.t)).encode() for r in rows]
    labels = np.array([LANGUAGES.index(r.l) for r in rows])
    keep = np.array([len(t) >= 12 for t in texts], bool)
    texts, labels = [t for t, k in zip(texts, keep) if k], labels[keep]
    net = ByteGru()
    net.train(texts, labels)
    lab = Labeler(net)
    told = np.array([int(lab.evidence(sentences_of(r.t)).sum(0).argmax()) for r, k in zip(rows, keep) if k])
    right = told == labels
    net.train([t for t, k in zip(texts, right) if k], labels[right], steps=200, rate=0.006, seed=11)
    return net


def pooled(texts: list[str | None], labeler: Labeler, least: float = 0.35) -> list[tuple[str | None, float]]:
    """The language of each whole text and how sure it is; null without letters."""
    parts = [sentences_of(t) if t else [] for t in texts]
    keys = [k for p in parts for k in p]
    e = labeler.evidence(keys)
    size = np.fromiter((len(k) - k.count(" ") for k in keys), "float64", len(keys))
    best = e.argmax(1)
    # as sure as the mean position is, over eight positions
    sure = 1 / np.exp(np.clip((e - e.max(1, keepdims=True)) / np.maximum(1, np.fromiter(map(len, keys), "float64", len(keys)))[:, None] * 8, -50, 0)).sum(1)
    out: list[tuple[str | None, float]] = []
    at = 0
    for p in parts:
        to = at + len(p)
        if not p:
            out.append((None, 0.0))
            continue
        shares = np.bincount(best[at:to], weights=size[at:to], minlength=len(LANGUAGES)) / size[at:to].sum()
        certain = float((sure[at:to] * size[at:to]).sum() / size[at:to].sum())
        order = np.argsort(-shares, kind="stable")
        if shares[order[1]] >= least:
            out.append((MIXED, min(1.0, float(shares[order[:2]].sum())) * certain))
        else:
            out.append((LANGUAGES[order[0]], float(shares[order[0]]) * certain))
        at = to
    return out


def _chunks(x: pd.DataFrame, size: pd.Series, most: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Parts of a batch with at most about ``most`` characters, so that memory doesn't depend on text lengths."""
    for _, y in x.groupby((size.cumsum() // most).to_numpy(), sort=False):
        yield y


def document_languages(docs: DataFrame, net: ByteGru, doc_id: str = "doc_id", text: str = "text", least: float = 0.35) -> DataFrame:
    """(doc_id, language, confidence): one row for each distinct id and text; null without letters. ``confidence`` is from 0 to 1."""
    src = spread(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("d is not null"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lab = labeler(net)
        for b in batches:
            for x in _chunks(b, b["t"].str.len().fillna(0)):
                found = pooled(x["t"].tolist(), lab, least)
                yield pd.DataFrame({"doc_id": x["d"], "language": [a for a, _ in found], "confidence": [c for _, c in found]})

    return src.mapInPandas(run, f"doc_id {dict(src.dtypes)['d']}, language string, confidence double")


def segment(units: list[str], evidence: np.ndarray, switch: float = 10.0, weight: float = 0.25) -> list[int]:
    """The language of each unit by the best path: changing the language costs ``switch``, half of it at a heading, which
    belongs to what follows."""
    e = evidence * weight
    n, k = e.shape
    score, came = e[0].copy(), np.zeros((n, k), "int64")
    for i in range(1, n):
        heading = units[i][-1] not in ".!?؟。！？।…\"'”’»」』)" and len(units[i]) < 40
        cost = switch * (0.5 if heading else 1.0)
        jump = int(score.argmax())
        stay = score >= score[jump] - cost
        came[i] = np.where(stay, np.arange(k), jump)
        score = np.where(stay, score, score[jump] - cost) + e[i]
    path = [int(score.argmax())]
    for i in range(n - 1, 0, -1):
        path.append(int(came[i][path[-1]]))
    return path[::-1]


def segments(units: DataFrame, net: ByteGru, key: str = "request_id") -> DataFrame:
    """(key, start_pos, end_pos, language): the longest runs of units in one language. ``units`` has the key, ``units`` (array of
    start_pos, end_pos and text of one record, in order)."""
    src = spread(units.select(F.col(key).alias("k"), "units"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lab = labeler(net)
        for b in batches:
            rows, at = [], 0
            keys = [" ".join(sentences_of(u["text"])) for us in b["units"] for u in us]
            told = lab.evidence(keys)
            for k, us in zip(b["k"], b["units"]):
                to = at + len(us)
                e, at = told[at:to], to
                if not len(us):
                    continue
                last = -1
                for u, lang in zip(us, segment([u["text"] for u in us], e)):
                    if lang != last:
                        rows.append([k, u["start_pos"], u["end_pos"], LANGUAGES[lang]])
                    rows[-1][2] = u["end_pos"]
                    last = lang
            yield pd.DataFrame(rows, columns=[key, "start_pos", "end_pos", "language"])

    return src.mapInPandas(run, f"{key} {dict(src.dtypes)['k']}, start_pos int, end_pos int, language string")


# Names of languages as they are written in labels.
NAMES = {
    "english": "en", "arabic": "ar", "french": "fr", "german": "de", "spanish": "es", "persian": "fa", "hindi": "hi", "chinese": "zh", "japanese": "ja", "thai": "th",
    "mixed": MIXED,
}


def code(label: Column) -> Column:
    """The code of a label given as code or name, in any case; null if it is missing or none of them."""
    low = F.lower(F.trim(label))
    return F.when(low.isin(*LANGUAGES, MIXED), low).otherwise(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])[low])
