"""Language identification by a linear-chain conditional random field over words.

Each word has hashed features: byte n-grams of the word between boundary marks (those
that touch a mark are its prefixes and suffixes) and the word itself as a lexicon entry.
Transition weights between the languages of neighbouring words are learned too, from
windows of texts in known languages that are joined into code-switched sequences.
Forward-backward gives every word's language; a text's language is the one with most
probability over its words.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without
labelled texts everything is ``und``; repeated rows are labelled each; equal scores go to
the language first in alphabetical order; an empty table gives an empty one. Texts and
words of any length are labelled whole, in memory of fixed size: the chain is cut into
chunks whose transfer matrices are multiplied first, which is exact, and a long text is
read twice, piece by piece (once for the matrices, once for the words).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine.llm.samples import draw_by_label, keep_bytes
from riskengine.llm.words import Words, keyed_text, mix, slices, split_words, text_bytes, text_slices
from riskengine.session import materialize

#: ASCII letters and all bytes beyond ASCII make words.
WORD_BYTES = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
UNKNOWN = "und"
_ASCII_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_CHUNK = 64
_LARGEST_GRAM = 4
#: Bytes whose features are looked up at once.
_BLOCK = 1 << 16
#: A text longer than this is labelled piece by piece.
_PIECE = 1 << 20


def _marked(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes one after the other, each between marks, and where each begins."""
    size = end - start
    first = np.concatenate([[0], np.cumsum(size + 2)])
    text = np.empty(first[-1], np.uint8)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(first[:-1] + 1, size) + inner] = data[np.repeat(start, size) + inner]
    text[first[:-1]], text[first[1:] - 1] = 1, 2
    return text, first


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each word, one word after the other, and where each word's begin."""
    text, first = _marked(data, start, end)
    at8 = np.ndarray((first[-1],), np.uint64, np.concatenate([text, np.zeros(8, np.uint8)]), 0, (1,))
    word = np.repeat(np.arange(len(start)), np.diff(first))
    left = first[1:][word] - np.arange(first[-1])
    found, owner = [hashes + np.uint64(77)], [np.arange(len(start))]
    for n in range(1, _LARGEST_GRAM + 1):
        ok = np.flatnonzero(left >= n)
        found.append((at8[ok] & np.uint64((1 << 8 * n) - 1)) * np.uint64(8) + np.uint64(n))
        owner.append(word[ok])
    owner, found = np.concatenate(owner), mix(np.concatenate(found)) >> np.uint64(64 - bits)
    order = np.argsort(owner, kind="stable")
    return found[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(start) + 1))


@dataclass
class CrfModel:
    """Word weights (2**bits x languages) and transition weights; of fixed size whatever the corpus."""

    languages: list[str]
    bits: int
    weight: np.ndarray
    transition: np.ndarray

    def emissions(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.empty((len(first) - 1, len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.add.reduceat(self.weight[features, k], first[:-1]) if len(features) else 0
        return out


    def word_scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """``emissions`` of words, block by block of bytes; a word longer than a block is cut, which changes no feature."""
        out = np.zeros((len(start), len(self.languages)))
        size = end - start
        total = np.cumsum(size + 2)
        at = 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _BLOCK, "right")))
            if size[at] + 2 > _BLOCK:
                word = np.concatenate([np.ones(1, np.uint8), data[start[at] : end[at]], np.full(1, 2, np.uint8)])
                for k in range(0, len(word), _BLOCK):
                    part = word[k : k + _BLOCK + _LARGEST_GRAM - 1]
                    n = min(_BLOCK, len(word) - k)
                    out[at] += self._gram_scores(part, np.arange(len(part), 0, -1)[:n], np.zeros(1, np.int64))[0]
            else:
                text, first = _marked(data, start[at:to], end[at:to])
                left = np.repeat(first[1:], np.diff(first)) - np.arange(first[-1])
                out[at:to] = self._gram_scores(text, left, first[:-1])
            at = to
        return out + self.weight[mix(hashes + np.uint64(77)) >> np.uint64(64 - self.bits)]

    def _gram_scores(self, text: np.ndarray, left: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sums over the n-grams that begin at each of ``len(left)`` bytes; ``left`` bytes of the word are left there."""
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        at8 = np.ndarray((len(left),), np.uint64, padded, 0, (1,))
        sums = np.zeros((len(left), len(self.languages)))
        for n in range(1, _LARGEST_GRAM + 1):
            gram = (at8 & np.uint64((1 << 8 * n) - 1)) * np.uint64(8) + np.uint64(n)
            found = self.weight[(mix(gram) >> np.uint64(64 - self.bits)).astype(np.int64)]
            found[left < n] = 0
            sums += found
        return np.add.reduceat(sums, first, axis=0)


def _scaled(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    return x / x.max(axis=axes, keepdims=True)


def transfer(emission: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The product of a chain's factors (transition, then word) up to its scale, halving the chain at each step."""
    m = a[None, :, :] * np.exp(emission - emission.max(axis=1, keepdims=True))[:, None, :] if len(emission) else np.eye(len(a))[None]
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        m = np.concatenate([_scaled(np.matmul(m[: len(m) - len(odd) : 2], m[1 :: 2]), (1, 2)), odd])
    return m[0]


def forward_backward(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, before: np.ndarray | None = None, behind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward and backward messages and the factors of all words of all texts.

    ``first[i]:first[i+1]`` are the words of text i. A virtual start, even over the
    languages, stands before each text, or the messages ``before`` and ``behind`` stand
    around it. Returns forward, backward, exp(emission) and exp(transition);
    forward * backward is each word's marginal up to its sum.
    """
    e, a = np.exp(emission - emission.max(axis=1, keepdims=True)), np.exp(transition)
    n_lang = len(a)
    size = np.diff(first)
    parts = -(-size // _CHUNK)
    head = np.cumsum(parts) - parts
    rank = np.arange(parts.sum()) - np.repeat(head, parts)
    begin = np.repeat(first[:-1], parts) + rank * _CHUNK
    length = np.minimum(np.repeat(first[1:], parts) - begin, _CHUNK)
    by_length = np.argsort(-length, kind="stable")
    live = [by_length[: np.searchsorted(-length[by_length], -t)] for t in range(int(length.max(initial=0)))]
    matrix = np.broadcast_to(np.eye(n_lang), (len(begin), n_lang, n_lang)).copy()
    for t, k in enumerate(live):
        m = (matrix[k].reshape(-1, n_lang) @ a).reshape(-1, n_lang, n_lang) * e[begin[k] + t][:, None, :]
        matrix[k] = _scaled(m, (1, 2))
    into, after = np.ones((len(begin), n_lang)), np.ones((len(begin), n_lang))
    into[head[parts > 0]] = 1.0 if before is None else before
    after[(head + parts - 1)[parts > 0]] = 1.0 if behind is None else behind
    deep = np.argsort(-parts, kind="stable")
    for j in range(1, int(parts.max(initial=0))):
        k = head[deep[: np.searchsorted(-parts[deep], -j)]] + j
        into[k] = _scaled(np.einsum("ki,kij->kj", into[k - 1], matrix[k - 1]), (1,))
    for j in range(int(parts.max(initial=0)) - 1, 0, -1):
        k = head[deep[: np.searchsorted(-parts[deep], -j)]] + j
        after[k - 1] = _scaled(np.einsum("kij,kj->ki", matrix[k], after[k]), (1,))
    forward, backward = np.empty_like(e), np.empty_like(e)
    f = into
    for t, k in enumerate(live):
        f[k] = _scaled((f[k] @ a) * e[begin[k] + t], (1,))
        forward[begin[k] + t] = f[k]
    b = after
    for t in range(len(live) - 1, -1, -1):
        k = live[t]
        backward[begin[k] + t] = b[k]
        b[k] = _scaled((e[begin[k] + t] * b[k]) @ a.T, (1,))
    return forward, backward, e, a


def marginals(emission: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    forward, backward, _, _ = forward_backward(emission, first, transition)
    p = forward * backward
    return p / p.sum(axis=1, keepdims=True)


def fit_crf(windows: list[tuple[str, bytes]], bits: int, epochs: int = 4, batch: int = 64, rate: float = 0.3, l2: float = 1e-4, seed: int = 7) -> CrfModel:
    """Maximum likelihood by AdaGrad over code-switched sequences of up to three windows each."""
    languages = sorted({lang for lang, _ in windows})
    n_lang, draw = len(languages), np.random.default_rng(seed)
    model = CrfModel(languages, bits, np.zeros((1 << bits, n_lang)), np.zeros((n_lang, n_lang)))
    if n_lang < 2:
        return model
    words = split_words(pa.array([w for _, w in windows], pa.binary()), WORD_BYTES)
    hashes = words.hashes()
    distinct, at, place = np.unique(hashes, return_index=True, return_inverse=True)
    features, begin = word_features(words.lower, words.start[at], words.end[at], distinct, bits)
    gold = np.array([languages.index(lang) for lang, _ in windows])
    seen, seen_t = np.full(model.weight.shape, 1e-8), np.full((n_lang, n_lang), 1e-8)
    for _ in range(epochs):
        order = draw.permutation(len(windows))
        joined = np.split(order, np.sort(draw.choice(np.arange(1, len(order)), max(0, len(order) // 2 - 1), replace=False))) if len(order) > 2 else [order]
        joined = [x[k : k + 3] for x in joined for k in range(0, len(x), 3)]
        for at in range(0, len(joined), batch):
            runs = [np.concatenate([np.arange(words.first[w], words.first[w + 1]) for w in seq]) for seq in joined[at : at + batch]]
            runs = [r for r in runs if len(r)]
            if not runs:
                continue
            token = np.concatenate(runs)
            first = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
            used, again = np.unique(place[token], return_inverse=True)
            n = begin[used + 1] - begin[used]
            feature = features[np.repeat(begin[used] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            emission = model.emissions(feature, np.concatenate([[0], np.cumsum(n)]))[again]
            forward, backward, e, a = forward_backward(emission, first, model.transition)
            p = forward * backward
            p /= p.sum(axis=1, keepdims=True)
            truth = gold[words.doc[token]]
            p[np.arange(len(token)), truth] -= 1
            per_word = np.zeros((len(used), n_lang))
            np.add.at(per_word, again, p)
            hit, back = np.unique(feature, return_inverse=True)
            grad = np.zeros((len(hit), n_lang))
            np.add.at(grad, back, np.repeat(per_word, n, axis=0))
            grad = grad / len(runs) + l2 * model.weight[hit]
            seen[hit] += grad * grad
            model.weight[hit] -= rate * grad / np.sqrt(seen[hit])
            inner = np.ones(len(token), bool)
            inner[first[:-1]] = False
            t = np.flatnonzero(inner)
            both = forward[t - 1][:, :, None] * a * (e[t] * backward[t])[:, None, :]
            both = (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            np.add.at(both, (truth[t - 1], truth[t]), -1.0)
            both = both / len(runs) + l2 * model.transition
            seen_t += both * both
            model.transition -= rate * both / np.sqrt(seen_t)
    return model


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_windows: int = 6000, window: int = 24, max_bytes: int = 4 << 20, bits: int = 16, max_languages: int = 128, **rates) -> CrfModel:
    """Fit on about ``max_windows`` windows of ``window`` whole words, one from each text that a hash chooses.

    A window is taken at a hash-chosen word. Copies of a text in one language count once,
    and each language has a fair part of the windows. The ``max_languages`` of most
    different texts are learned, which bounds the model too; others are never predicted. Where the windows have more than
    ``max_bytes`` in all, as words may be of any length, a fair part in bytes of each
    language's windows is kept; the driver gets about that many bytes at most.
    """
    known = docs.select(F.col(lang_col).cast("string").alias("_lang"), F.encode(F.col(text_col), "UTF-8").alias("_raw"), F.xxhash64(F.encode(F.col(text_col), "UTF-8")).alias("_h"), F.col(text_col).rlike(r"[A-Za-z]|[^\x00-\x7F]").alias("_has_word"))
    known = draw_by_label(known.filter("_lang IS NOT NULL AND _has_word").drop("_has_word"), "_lang", "_h", max_windows, max_languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_raw"):
            pick = b.column(2).to_numpy().view(np.uint64) >> np.uint64(33)
            words, out = split_words(b.column(1), WORD_BYTES), []
            for i in range(words.n_docs):
                lo, hi = words.first[i], words.first[i + 1]
                at = lo + int(pick[i]) % max(1, hi - lo - window + 1) if hi > lo else lo
                out.append(b" ".join(words.lower[words.start[k] : words.end[k]].tobytes() for k in range(at, min(hi, at + window))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), b.column(2)], ["lang", "window", "h"])

    drawn = materialize(known.mapInArrow(run, "lang string, window binary, h long").distinct(), "language-windows")
    rows = keep_bytes(drawn, "lang", "h", "window", max_bytes).collect()
    rows = sorted((r.h, r.lang, bytes(r.window)) for r in rows if r.window)
    return fit_crf([(lang, w) for _, lang, w in rows], bits, **rates)


def _word_scores(model: CrfModel, words: Words) -> np.ndarray:
    """Every word's emissions; those of equal words are worked out once."""
    distinct, at, place = np.unique(words.hashes(), return_index=True, return_inverse=True)
    return model.word_scores(words.lower, words.start[at], words.end[at], distinct)[place]


def _word_marginals(model: CrfModel, texts: pa.Array) -> tuple[Words, np.ndarray]:
    words = split_words(texts, WORD_BYTES)
    return words, marginals(_word_scores(model, words), words.first, model.transition)


def pieces(raw: np.ndarray, most: int = _PIECE) -> list[tuple[int, int]]:
    """Byte ranges of about ``most`` bytes that cut a text between words only."""
    out, at = [], 0
    while at < len(raw):
        to = at + most
        while to < len(raw):  # on to the next byte outside words
            gap = np.flatnonzero(~WORD_BYTES[raw[to : to + _BLOCK]])
            if len(gap):
                to += int(gap[0])
                break
            to += _BLOCK
        out.append((at, min(to, len(raw))))
        at = out[-1][1]
    return out


def long_marginals(model: CrfModel, raw: np.ndarray, most: int = _PIECE) -> Iterator[tuple[int, Words, np.ndarray]]:
    """Of one text of any length, piece by piece: the first byte, the words and their marginals."""
    a, n_lang = np.exp(model.transition), len(model.languages)
    cuts = pieces(raw, most)
    split = lambda k: split_words(pa.array([raw[cuts[k][0] : cuts[k][1]].tobytes()], pa.binary()), WORD_BYTES)
    into, through = [np.ones(n_lang)], []
    for k in range(len(cuts)):
        words = split(k)
        through.append(transfer(_word_scores(model, words), a))
        into.append(_scaled(into[-1] @ through[-1], (0,)))
    after = [np.ones(n_lang)]
    for m in reversed(through[1:]):
        after.append(_scaled(m @ after[-1], (0,)))
    for k in range(len(cuts)):
        words = split(k)
        forward, backward, _, _ = forward_backward(_word_scores(model, words), words.first, model.transition, into[k], after[len(cuts) - 1 - k])
        p = forward * backward
        yield cuts[k][0], words, p / p.sum(axis=1, keepdims=True)


def _language_sums(model: CrfModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text: the languages' probability over its words, and whether it has a letter."""
    raw, off = text_bytes(texts)
    if len(texts) == 1 and len(raw) > _PIECE:
        total, letter = np.zeros((1, len(model.languages))), np.zeros(1, bool)
        for _, words, p in long_marginals(model, raw):
            total[0] += p.sum(axis=0)
            letter[0] = letter[0] or _has_letter(words)[0]
        return total, letter
    words, p = _word_marginals(model, texts)
    return np.stack([np.bincount(words.doc, p[:, k], words.n_docs) for k in range(p.shape[1])], axis=1), _has_letter(words)


def _has_letter(words: Words) -> np.ndarray:
    """Whether each text has a letter; bytes beyond ASCII are looked at only where no ASCII letter is."""
    out = np.zeros(words.n_docs, bool)
    for i in range(words.n_docs):
        lo, hi = words.first[i], words.first[i + 1]
        if lo < hi:
            said = words.lower[words.start[lo] : words.end[hi - 1]]
            out[i] = _ASCII_LETTER[said].any() or any(map(str.isalpha, said.tobytes().decode("utf-8", "replace")))
    return out


def predict(docs: DataFrame, model: CrfModel, text_col: str = "text", keep: tuple[str, ...] | None = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``lang_pred`` and ``lang_score``, its share of all words' probability.

    Without ``keep`` the whole row comes along in one column ``row``, and its text is not sent to Python twice.
    """
    kept = keyed_text(docs, text_col, keep)
    schema = T.StructType([kept.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], object)
        for row, texts in text_slices(batches, text_col, _PIECE):
            lang, score = np.full(len(texts), len(model.languages)), np.zeros(len(texts))
            if model.languages:
                total, ok = _language_sums(model, texts)
                lang[ok] = total[ok].argmax(axis=1)
                score[ok] = np.minimum(1.0, total[ok].max(axis=1) / total[ok].sum(axis=1))
            yield pa.RecordBatch.from_arrays([row, pa.array(names[lang], pa.string()), pa.array(score)], ["row", "lang_pred", "lang_score"])

    found = kept.mapInArrow(run, schema)
    return found if keep is None else found.select("row.*", "lang_pred", "lang_score")


def _runs(words: Words, best: np.ndarray, lo: int, hi: int, shift: int, languages: list[str], into: list[dict]) -> None:
    """Add the runs of words ``lo:hi`` of one language to a text's spans; a run goes on from the span before."""
    for at in np.split(np.arange(lo, hi), np.flatnonzero(np.diff(best[lo:hi])) + 1) if hi > lo else []:
        span = {"start": int(words.start[at[0]]) + shift, "end": int(words.end[at[-1]]) + shift, "lang": languages[best[at[0]]]}
        if into and into[-1]["lang"] == span["lang"]:
            into[-1]["end"] = span["end"]
        else:
            into.append(span)


def label_spans(docs: DataFrame, model: CrfModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For code-switched text: ``spans``, the runs of words of one language with byte offsets in the UTF-8 text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        for b in slices(batches, "_raw", _PIECE):
            out: list[list[dict]] = [[] for _ in range(b.num_rows)]
            raw, off = text_bytes(b.column(1))
            if model.languages and b.num_rows == 1 and len(raw) > _PIECE:
                for at, words, p in long_marginals(model, raw):
                    _runs(words, p.argmax(axis=1), 0, len(words.start), at, model.languages, out[0])
            elif model.languages:
                words, p = _word_marginals(model, b.column(1))
                best = p.argmax(axis=1)
                for i in range(b.num_rows):
                    _runs(words, best, words.first[i], words.first[i + 1], -int(off[i]), model.languages, out[i])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, of)], [id_col, "spans"])

    return docs.select(id_col, F.encode(F.col(text_col), "UTF-8").alias("_raw")).mapInArrow(run, f"{id_col} {kind}, spans array<struct<start:long,end:long,lang:string>>")
