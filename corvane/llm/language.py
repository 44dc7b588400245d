"""Language identification: script ranges, per-word scores, and Viterbi over words.

A word's script, by the Unicode ranges of its letters, leaves the languages that were seen
in that script. Each of those scores the word by smoothed character n-grams. A Viterbi pass
over the document's words, with a penalty for each switch, labels spans of one language;
the document's language is that of the most letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from . import wordgrams as wg
from .shared import held_out

SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 17
#: First code points of Unicode ranges, and the script of each.
SCRIPT_STARTS = (0x0000, 0x0370, 0x0400, 0x0530, 0x0590, 0x0600, 0x0900, 0x0980, 0x0E00, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3400, 0xAC00, 0xD800)
SCRIPTS = ("Latin", "Greek", "Cyrillic", "Armenian", "Hebrew", "Arabic", "Devanagari", "Indic", "Thai", "Georgian", "Hangul", "Ethiopic", "Latin", "Greek", "Other", "Hiragana", "Katakana", "Other", "Han", "Hangul", "Other")
SCRIPT_NAMES = tuple(dict.fromkeys(SCRIPTS))
SCRIPT_IDS = np.array([SCRIPT_NAMES.index(s) for s in SCRIPTS])

ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


LETTERS: dict[str, np.ndarray] = {}
#: Distinct words whose scores a task keeps between slices; beyond this it starts anew.
KNOWN_WORDS = 1 << 17
#: Viterbi runs over all stretches of so many words at once, whatever the documents' lengths.
STRETCH = 32


def letters_table() -> np.ndarray:
    """Which code points are letters; built when a non-ASCII word comes first."""
    if not LETTERS:
        LETTERS["table"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return LETTERS["table"]


def word_letters(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's number of letters, and the script of most of them; without letters the first script."""
    before = np.concatenate([[0], np.cumsum(ASCII_LETTER[data], dtype=np.int32)])
    letters = (before[end] - before[start]).astype(np.int64)
    script = np.zeros(len(start), np.int64)
    before = np.concatenate([[0], np.cumsum(data >= 128, dtype=np.int32)])
    wide = np.flatnonzero(before[end] > before[start])
    if len(wide):
        size = end[wide] - start[wide]
        own = data[np.repeat(start[wide], size) + tk.ranges(size)]
        code = np.frombuffer(own.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(wide)), size)[(own & 0xC0) != 0x80]
        keep = letters_table()[code]
        word, found = word[keep], SCRIPT_IDS[np.searchsorted(SCRIPT_STARTS, code[keep], "right") - 1]
        often = np.bincount(word * len(SCRIPT_NAMES) + found, minlength=len(wide) * len(SCRIPT_NAMES)).reshape(len(wide), -1)
        letters[wide], script[wide] = often.sum(1), often.argmax(1)
    return letters, script


class Words:
    """A piece's words, and the distinct ones among them: hashes, and byte spans in lower-case data."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = tk.LOWER[data]
        self.words = w = tk.Words(self.data, offsets, tk.SPACED)
        self.hashes, place, self.which = np.unique(tk.span_hashes(self.data, w.start, w.end), return_index=True, return_inverse=True)
        self.start, self.end = w.start[place], w.end[place]


class Known:
    """Scores and letters of the words that a task has met, by hash."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.hashes, self.at = np.zeros(0, tk.U), np.zeros(0, np.int32)
        self.scores, self.letters = np.zeros((0, len(self.model.langs)), np.float32), np.zeros(0, np.int32)

    def rows(self, w: Words) -> np.ndarray:
        """The row of scores of each word of w."""
        place = np.searchsorted(self.hashes, w.hashes)
        old = np.zeros(len(w.hashes), bool)
        inside = place < len(self.hashes)
        old[inside] = self.hashes[place[inside]] == w.hashes[inside]
        new = np.flatnonzero(~old)
        if len(new):
            letters, scores = self.model.word_scores(w.data, w.start[new], w.end[new])
            fresh = np.arange(len(new), dtype=np.int32) + len(self.letters)
            self.hashes, self.at = np.insert(self.hashes, place[new], w.hashes[new]), np.insert(self.at, place[new], fresh)
            self.scores, self.letters = np.concatenate([self.scores, scores]), np.concatenate([self.letters, letters.astype(np.int32)])
            place = np.searchsorted(self.hashes, w.hashes)
        return self.at[place][w.which] if len(place) else np.zeros(0, np.int32)


class Model:
    """Per language: which scripts it was seen in, and its n-grams' log probabilities."""

    def __init__(self, texts: list[str], langs: list[str], smoothing: float = 0.5, penalty: float = 6.0, most: float = 4.0, least_share: float = 0.01):
        self.langs, self.penalty, self.most = sorted(set(langs)), penalty, most
        index = {x: i for i, x in enumerate(self.langs)}
        k = len(self.langs)
        hashes, often, spans, kept, base = [], [], [], [], 0
        batch = pa.record_batch([wg.arrow_texts(texts), pa.array([index[x] for x in langs], pa.int64())], ["text", "lang"])
        for part in tk.small_slices(iter([batch])):
            own = part.column(1).to_numpy()
            for data, off in tk.pieces(*tk.buffer_of(part.column(0)), tk.SPACED):
                w = Words(data, off)
                n = len(w.hashes)
                hashes.append(w.hashes)
                often.append(np.bincount(own[w.words.doc] * n + w.which, minlength=k * n).reshape(k, n).T)
                size = w.end - w.start
                kept.append(w.data[np.repeat(w.start, size) + tk.ranges(size)])
                spans.append(base + np.cumsum(size) - size)
                base += len(kept[-1])
        seen, scripts = np.zeros((k, BUCKETS)), np.zeros((k, len(SCRIPT_NAMES)))
        if base:
            _, place, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
            counts = np.zeros((len(place), k))
            np.add.at(counts, which, np.concatenate(often))
            counts = np.sqrt(counts)
            data, start = np.concatenate(kept), np.concatenate(spans)
            start, end = start[place], np.append(start, base)[place + 1]
            letters, script = word_letters(data, start, end)
            for a, b, word, gram in wg.gram_chunks(data, start, end, SIZES, BUCKETS):
                for j in range(k):
                    seen[j] += np.bincount(gram, counts[a:b, j][word], BUCKETS)
            for j in range(k):
                scripts[j] = np.bincount(script, counts[:, j] * letters, len(SCRIPT_NAMES))
        self.logs = np.log((seen + smoothing) / (seen.sum(1, keepdims=True) + smoothing * BUCKETS)).T.astype(np.float32).copy()
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1e-9)
        self.allowed = share >= least_share
        self.allowed[:, ~self.allowed.any(0)] = True  # a script seen in no language rules none out

    def word_scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters, and log likelihoods less their mean, within +-most, of words; zero for words without letters."""
        n, k = len(start), len(self.langs)
        letters, script = word_letters(data, start, end)
        out = np.zeros((n, k))
        for a, b, word, gram in wg.gram_chunks(data, start, end, SIZES, BUCKETS):
            size = np.maximum(np.bincount(word, minlength=b - a), 1)
            for j in range(k):
                # n-grams of a long word overlap
                out[a:b, j] = np.bincount(word, self.logs[gram, j], b - a) * (np.minimum(size, 12) / size)
        out = np.clip(out - out.mean(1, keepdims=True), -self.most, self.most)
        out[~self.allowed.T[script]] = -2 * self.most
        out[letters == 0] = 0
        return letters, out.astype(np.float32)

    def path(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The language of each word on each document's best path.

        Documents are cut into stretches. A first pass gives each stretch's best score from
        each language before it to each at its end; with these the documents' scores at the
        stretches' starts follow, and all stretches run Viterbi at once.
        """
        k = len(self.langs)
        words = np.diff(first)
        many = -(-words // STRETCH)
        doc, rank = np.repeat(np.arange(len(words)), many), tk.ranges(many)
        base = first[:-1][doc] + rank * STRETCH
        size = np.minimum(words[doc] - rank * STRETCH, STRETCH)
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        base, size = base[order], size[order]
        active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")  # stretches of over t words

        whole = np.full((len(base), k, k), -self.penalty, np.float32)
        whole[:, np.arange(k), np.arange(k)] = 0
        for t, m in enumerate(active.tolist()):
            s = whole[:m]
            if t:
                np.maximum(s, s.max(2, keepdims=True) - np.float32(self.penalty), out=s)
            s += scores[base[:m] + t][:, None, :]

        # documents of most stretches first; their stretches follow each other in `place`
        deep = np.argsort(-many, kind="stable")
        at_doc = (np.cumsum(many) - many)[deep]
        rounds = np.searchsorted(-many[deep], -np.arange(int(many.max()) if len(many) else 0), "left").tolist()
        enter, state = np.zeros((len(base), k)), np.zeros((len(deep), k))
        for r, m in enumerate(rounds):
            c = place[at_doc[:m] + r]
            enter[c] = state[:m]
            out = (state[:m, :, None] + whole[c]).max(1)
            state[:m] = out - out.max(1, keepdims=True)

        state_in = enter
        stays, best = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int8 if k < 128 else np.int32)
        for t, m in enumerate(active.tolist()):
            at, s = base[:m] + t, state_in[:m]
            top = s.argmax(1)
            peak = s[np.arange(m), top] - self.penalty
            best[at], stays[at] = top, s >= peak[:, None]
            np.maximum(s, peak[:, None], out=s)
            s += scores[at]

        def back(now: np.ndarray, write: np.ndarray | None = None) -> np.ndarray:
            """From each stretch's last language the one before it."""
            for t in range(len(active) - 1, -1, -1):
                m = active[t]
                at = base[:m] + t
                if write is not None:
                    write[at] = now[:m]
                now[:m] = np.where(stays[at, now[:m]], now[:m], best[at])
            return now

        before = np.stack([back(np.full(len(base), j)) for j in range(k)], 1)
        last, now = np.zeros(len(base), np.int64), state.argmax(1)
        for r in range(len(rounds) - 1, -1, -1):
            m = rounds[r]
            c = place[at_doc[:m] + r]
            last[c] = now[:m]
            now[:m] = before[c, now[:m]]
        out = np.zeros(len(scores), best.dtype)
        back(last, out)
        return out

    def label(self, texts: pa.Array, known: Known | None = None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each text's language, score and share of letters in that language, where its words start, and each word's language."""
        n_docs, k = len(texts), len(self.langs)
        known = known or Known(self)
        if len(known.letters) > KNOWN_WORDS:
            known.clear()
        rows, counts = [], np.zeros(n_docs, np.int64)
        for data, off in tk.pieces(*tk.buffer_of(texts), tk.SPACED):
            w = Words(data, off)
            counts += w.words.counts
            rows.append(known.rows(w) if k else np.zeros(len(w.which), np.int32))
        rows, first = np.concatenate(rows), np.concatenate([[0], np.cumsum(counts)])
        if not k:
            return ["und"] * n_docs, np.zeros(n_docs), np.zeros(n_docs), first, np.zeros(len(rows), np.int8)
        doc, letters, scores = np.repeat(np.arange(n_docs), counts), known.letters[rows], known.scores[rows]
        path = self.path(scores, first)
        mass = np.bincount(doc * k + path, letters, n_docs * k).reshape(n_docs, k)
        top = mass.argmax(1)
        lead = np.full(n_docs, 9.0)
        if k > 1:
            at = (np.arange(len(doc)), top[doc])
            own = scores[at]
            scores[at] = -np.inf
            lead = np.bincount(doc, own - scores.max(1, initial=-np.inf), n_docs)
        share = mass[np.arange(n_docs), top] / np.maximum(mass.sum(1), 1e-9)
        some = mass.sum(1) > 0
        score = np.where(some, share / (1 + np.exp(-np.clip(lead, -30, 30))), 0.0)
        return [self.langs[j] if ok else "und" for j, ok in zip(top.tolist(), some.tolist(), strict=True)], score, share, first, path

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(first word, word after the last, language) of each span of one language."""
        _, _, _, first, path = self.label(pa.array([text]))
        return [(a, b, x) for a, b, x in zip(*(c.to_pylist() for c in span_lists(self, first, path).flatten().flatten()), strict=True)]


SPAN = pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])


def span_lists(model: Model, first: np.ndarray, path: np.ndarray) -> pa.Array:
    """For each document its spans of one language: first word, word after the last, language."""
    new = np.zeros(len(path), bool)
    new[1:] = path[1:] != path[:-1]
    new[first[:-1][np.diff(first) > 0]] = True
    at = np.flatnonzero(new)
    doc = np.searchsorted(first, at, "right") - 1
    end = np.append(at[1:], len(path)) if len(at) else at
    langs = pa.DictionaryArray.from_arrays(pa.array(path[at].astype(np.int32)), pa.array(model.langs or ["und"], pa.string())).cast(pa.string()) if len(at) else pa.array([], pa.string())
    items = pa.StructArray.from_arrays([pa.array((at - first[doc]).astype(np.int32)), pa.array((end - first[doc]).astype(np.int32)), langs], fields=list(SPAN))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first).astype(np.int32)), items)


def trained(docs: DataFrame, modulus: int = 4, remainder: int = 2, most: int = 600) -> Model:
    """A model of the rows that have a language and aren't held out, at most about `most` of each and wordgrams.TRAINING_BYTES of text."""
    known = docs.filter(F.col("lang").isNotNull() & ~held_out("doc_id", modulus, remainder))
    some = wg.sample(known.select("doc_id", "lang", "text"), "lang", most, F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    return wg.fitted(some.filter("text is not null"), lambda x: Model(x["text"].tolist(), x["lang"].tolist()))


def labelled(model) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(model.value)
        for batch in tk.small_slices(batches):
            langs, score, _, first, path = model.value.label(batch.column(2), known)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(score), span_lists(model.value, first, path)], ["doc_id", "held_out", "lang_pred", "score", "spans"])

    return run


def identify(docs: DataFrame, modulus: int = 4, remainder: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, a score of 0 to 1, and spans for each row of docs.

    lang_pred is a language that the training rows have, or und where the text is null or
    has no letter, or where there are no training rows; the score is then 0. The score is
    the share of letters in that language's spans times the probability that it beats the
    next. spans are the stretches of words (runs without white space, from 0) of one
    language, as first, end and lang; words without letters go with their neighbours. A
    null, empty or blank text has none. Of languages with equally many letters the first by
    name is taken. A very long text is scored in pieces cut between words and labelled in
    one path. Repeated rows, and rows of one id, are labelled each by its own text. An empty
    table gives no rows. Other columns, whatever their names, are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, modulus, remainder, **options))
    rows = docs.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "text")
    return rows.mapInArrow(labelled(model), "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<first:int,end:int,lang:string>>")


def keep_identified(docs: DataFrame, least_share: float = 0.5) -> DataFrame:
    """The rows of docs of which one language's spans hold at least `least_share` of the letters, all columns, lang replaced by that language.

    Null, empty and letterless texts go, and all rows if there are no training rows.
    Repeated rows stay or go together. An empty table stays empty; a table without the
    column lang raises an error, as it holds nothing to learn from.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(docs))
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(model.value)
        for batch in tk.small_slices(batches):
            langs, _, share, _, _ = model.value.label(batch.column(names.index("text")), known)
            at = names.index("lang")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(langs, pa.string()).cast(batch.schema.field(at).type))
            yield batch.filter(pa.array([x != "und" and s >= least_share for x, s in zip(langs, share.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op8(docs: DataFrame) -> DataFrame:
    """identify(), which says what becomes of nulls, long texts, repeats and empty tables."""
    return identify(docs)
