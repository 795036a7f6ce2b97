"""Languages of documents and of their segments by error-correcting output codes (problem 9).

Each language has a codeword of ``len(CODE[0])`` bits: all ways to split the six languages in two of which three
languages a side or two against four are kept. One *binary n-gram classifier* per bit (log-odds of hashed letter
3- and 4-grams within words, languages weighing alike on each side) predicts the bit of a sentence. *Loss-weighted
decoding* sums, over the bits, the logistic loss between prediction and codeword, weighted by how often the bit's
classifier was right in training, and takes the nearest codeword; a small lead over the second is flagged as
ambiguous. Confidence is a softmax of the losses; its steepness is fitted on sentences held out from the counts, so
that it is calibrated.

The classifiers are fitted on about ``TRAIN_DOCS`` documents with a usable label, chosen by a hash of their id,
in two passes: the second leaves out sentences that contradict their label by the first, as labels are noisy; one
document in ``HELD_OUT`` serves for the calibration only. Everything else runs over all documents and whole texts in
one narrow map; nothing is shuffled but the counts. A word's sum of classifier weights is computed once a task, as
words recur.

Letters are compared lower-cased, without accents, markup, invisible characters or digits. Sentences end at
.!?, line breaks and line-break tags. Segments are of four kinds: a whole ``sentence``; a ``part`` between spaced
dashes, as a language may change there; a ``quote``, passages in quotation marks; and ``short``, what has fewer than
``MIN_WORDS`` words. All are classified. A document's languages are those of its sentences and parts; short segments
and quotes count only in a document that has nothing else.

Defined results: NULL, blank or wordless texts have no language and give no row; a document in one language
gives one row, a mixed one a row for each language; repeated ids are treated row by row; without any usable label
nothing can be learnt and there are no rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.session import ship
from curaspark.storage import materialize, release

LANGS = ["de", "en", "es", "fr", "it", "pt"]
TRAIN_DOCS = 20_000
FEATURES = 1 << 16
MIN_WORDS = 4
MIN_LEAD = 2.0
SMOOTH = 0.5
DAMP = 0.15
HELD_OUT = 5
STEEP = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 5.6, 8.0]
CACHE_WORDS = 200_000
KINDS = ["sentence", "part", "quote", "short"]

# How labels name the six languages.
NAMES = {
    "de": "de deu ger german deutsch allemand aleman tedesco alemao",
    "en": "en eng english englisch anglais ingles inglese",
    "es": "es spa esp spanish castellano espanol spanisch espagnol spagnolo espanhol",
    "fr": "fr fra fre french francais franzosisch frances francese",
    "it": "it ita italian italiano italienisch italien",
    "pt": "pt por portuguese portugues portugiesisch portugais portoghese",
}
CANONICAL = {name: lang for lang, names in NAMES.items() for name in names.split()}


def code_words() -> np.ndarray:
    """Languages x bits of -1 and 1: the splits into three and three, and into two and four."""
    splits = [s for s in combinations(range(6), 3) if 0 in s] + list(combinations(range(6), 2))
    return np.array([[1.0 if k in s else -1.0 for s in splits] for k in range(6)], dtype=np.float32)


CODE = code_words()

ACCENTS = re.compile("[\u0300-\u036f]+")
INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
BREAK_TAG = re.compile(r"<\s*(?:br|p|/p|div|/div|li|/li)\b[^<>]*>", re.I)
TAG = re.compile(r"<[^<>]+>")
THREAD_REF = re.compile(r">>\d+")
QUOTED = re.compile(r"«[^»]*»|“[^”]*”|„[^“”]*[“”]|\"[^\"\n]*\"|‹[^›]*›")
SENTENCE_END = re.compile("[.!?…]+(?=\\s|$)|[\\n\\r\u2028\u2029]+")
DASH = re.compile(r"\s[-–—](?=\s)")
WORD = re.compile("[a-z]+")
QUOTE_MARKS = "«»“”„\"‹›"
LIGATURES = [("ß", "ss"), ("œ", "oe"), ("æ", "ae")]


def canonical_label(column: F.Column) -> F.Column:
    """The language a label names, else NULL; region suffixes and case don't count."""
    plain = F.lower(F.trim(column))
    plain = F.translate(plain, "éèêëáàâãäíìîïóòôõöúùûüñç", "eeeeaaaaaiiiiooooouuuunc")
    first = F.regexp_extract(plain, r"^([a-z]+)(?:[-_ (.,].*)?$", 1)
    pairs = [F.lit(x) for pair in CANONICAL.items() for x in pair]
    return F.create_map(*pairs)[first]


def plain_text(text: str) -> str:
    """Lower-cased, without markup, thread links, invisible characters and accents."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", BREAK_TAG.sub("\n", text))
    if ">>" in text:
        text = THREAD_REF.sub("\n", text)
    if not text.isascii():
        text = ACCENTS.sub("", unicodedata.normalize("NFKD", INVISIBLE.sub("", text))).lower()
        for letter, plain in LIGATURES:
            text = text.replace(letter, plain)
    return text.lower()


def segments_of(text: str | None) -> tuple[list[list[str]], list[int], list[int]]:
    """Words of each segment in order, its kind (position in ``KINDS``) and the number of its sentence. Empty if there are no words."""
    if not text:
        return [], [], []
    body = plain_text(text).strip()
    if len(body) > 1 and body[0] in QUOTE_MARKS and body[-1] in QUOTE_MARKS:
        body = body[1:-1]  # the whole text in quotation marks is no quotation within it
    out: list[list[str]] = []
    kinds: list[int] = []
    of: list[int] = []
    n = 0
    at = 0
    chunks: list[tuple[str, bool]] = []
    for m in QUOTED.finditer(body):
        chunks += [(body[at : m.start()], False), (m[0], True)]
        at = m.end()
    chunks.append((body[at:], False))
    for chunk, quoted in chunks:
        for sentence in SENTENCE_END.split(chunk):
            n += 1
            words = WORD.findall(sentence)
            if not words:
                continue
            parts = [x for x in map(WORD.findall, DASH.split(sentence)) if x] if not quoted and ("-" in sentence or "–" in sentence or "—" in sentence) else [words]
            if len(parts) == 1 or all(len(x) < MIN_WORDS for x in parts):
                parts = [words]
            for own in parts:
                out.append(own)
                of.append(n)
                kinds.append(2 if quoted else 3 if len(own) < MIN_WORDS else 0 if len(parts) == 1 else 1)
    return out, kinds, of


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each letter 3- and 4-gram of the words, blanks around them included, and the word of each, in order."""
    joined = np.frombuffer(f" {' '.join(words)}    ".encode("ascii"), dtype=np.uint8).astype(np.uint32)
    blank = joined == 32
    of = np.cumsum(blank[:-3]) - 1
    three = (joined[:-3] << 16) ^ (joined[1:-2] << 8) ^ joined[2:-1]
    four = (three * np.uint32(257)) ^ joined[3:]
    mix = lambda x, k: ((x * np.uint32(k)) >> np.uint32(16)) & np.uint32(FEATURES - 1)
    ids = np.stack([mix(three, 2654435761), mix(four, 2246822519)], axis=1)
    whole = np.stack([~blank[1:-2], ~blank[1:-2] & ~blank[2:-1]], axis=1)
    whole[of >= len(words)] = False
    return ids[whole].astype(np.int64), np.repeat(of, 2)[whole.ravel()]


def _chunks(starts: np.ndarray, total: int, most: int = 100_000) -> Iterator[tuple[int, int, int, int]]:
    """Runs of rows with about ``most`` entries each: first and last entry, first and last row."""
    row = 0
    while row < len(starts):
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + most)))
        yield int(starts[row]), int(starts[end]) if end < len(starts) else total, row, end
        row = end


class Model:
    """Classifier weights by feature and bit, and the weight of each bit's loss."""

    def __init__(self, counts: np.ndarray):
        self.known = counts.sum(1) > 0
        share = counts + SMOOTH
        share = share / share.sum(1, keepdims=True)
        share[~self.known] = 1.0 / FEATURES
        side = lambda sign: share[[bool(k) for k in sign]].mean(0)
        self.weights = np.stack([np.log(side(b > 0)) - np.log(side(b < 0)) for b in CODE.T], axis=1).astype(np.float32)
        self.bit_weight = np.ones(CODE.shape[1], dtype=np.float32)
        self.steep = 1.0
        self.place: dict[str, int] = {}  # words met, and the sums of their weights
        self.sums = np.zeros((0, CODE.shape[1]), dtype=np.float32)

    def margins(self, segments: list[list[str]]) -> np.ndarray:
        """Segments x bits."""
        if not segments:
            return np.zeros((0, CODE.shape[1]), dtype=np.float32)
        if len(self.place) > CACHE_WORDS:
            self.place, self.sums = {}, self.sums[:0]
        place = self.place
        fresh = list({w for words in segments for w in words if w not in place})
        if fresh:
            ids, of = word_features(fresh)
            starts = np.searchsorted(of, np.arange(len(fresh)))
            more = np.concatenate([np.add.reduceat(self.weights[ids[a:b]], starts[c:d] - a, axis=0) for a, b, c, d in _chunks(starts, len(ids))])
            place.update(zip(fresh, range(len(self.sums), len(self.sums) + len(fresh))))
            self.sums = np.concatenate([self.sums, more])
        sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        flat = np.fromiter((place[w] for words in segments for w in words), dtype=np.int64, count=int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        return np.concatenate([np.add.reduceat(self.sums[flat[a:b]], starts[c:d] - a, axis=0) for a, b, c, d in _chunks(starts, len(flat))]) * DAMP

    def __getstate__(self) -> dict:
        return self.__dict__ | {"place": {}, "sums": self.sums[:0]}

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Segments x languages: weighted logistic loss between margins and codewords, a bit's share of all."""
        scale = self.bit_weight / self.bit_weight.sum()
        losses = np.stack([np.logaddexp(0, -margins * CODE[k]) @ scale for k in range(len(LANGS))], axis=1)
        losses[:, ~self.known] = np.inf
        return losses


def _order(losses: np.ndarray, steep: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its lead over the second, and its confidence."""
    best = losses.argmin(1)
    two = np.sort(losses, axis=1)[:, :2]
    lead = np.nan_to_num(two[:, 1] - two[:, 0], posinf=99.0)
    return best, lead, 1 / np.exp(-steep * (losses - two[:, :1])).sum(1)


def _count(shared, schema_names: list[str]):
    """Partition -> feature counts by language of the labelled sentences; with a model, of those that it doesn't contradict, and its right bits (language -1).

    Documents held out give, with a model, the log-loss of each steepness (language -2, in millionths) instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        counts = np.zeros((len(LANGS), FEATURES), dtype=np.int64)
        right = np.zeros(CODE.shape[1], dtype=np.int64)
        loss = np.zeros(len(STEEP))
        for batch in batches:
            found: tuple[list, list] = ([], [])
            label: tuple[list, list] = ([], [])
            for lang, text, held in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own, kinds, _ = segments_of(text)
                own = [x for x, kind in zip(own, kinds) if kind < 2]
                found[held].extend(own)
                label[held].extend([LANGS.index(lang)] * len(own))
            segments, labels = found[0], np.array(label[0], dtype=np.int64)
            if model is not None and found[1]:
                losses = model.losses(model.margins(found[1]))
                losses = losses - losses.min(1, keepdims=True)
                truth = np.array(label[1])
                for k, steep in enumerate(STEEP):
                    chance = np.exp(-steep * losses)
                    chance = chance[np.arange(len(truth)), truth] / chance.sum(1)
                    loss[k] -= np.log(0.9 * chance + 0.1 / len(LANGS)).sum()  # a tenth of the labels may say anything
            if model is not None and segments:
                margins = model.margins(segments)
                same = model.losses(margins).argmin(1) == labels
                right += ((margins > 0) == (CODE[labels] > 0))[same].sum(0)
                segments, labels = [f for f, s in zip(segments, same) if s], labels[same]
            for k in range(len(LANGS)):
                times = Counter(w for words, x in zip(segments, labels) if x == k for w in words)
                if times:
                    ids, of = word_features(list(times))
                    weight = np.fromiter(times.values(), dtype=np.float64, count=len(times))
                    counts[k] += np.bincount(ids, weights=weight[of], minlength=FEATURES).astype(np.int64)
        langs, ids = np.nonzero(counts)
        bits, steeps = np.flatnonzero(right), np.flatnonzero(loss)
        columns = [
            np.concatenate([langs, np.full(len(bits), -1), np.full(len(steeps), -2)]), np.concatenate([ids, bits, steeps]),
            np.concatenate([counts[langs, ids], right[bits], (loss[steeps] * 1e6).astype(np.int64)]),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()))], names=schema_names)

    return run


def fit(documents: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Classifiers from the noisy labels of a bounded sample."""
    spark = documents.sparkSession
    ship(spark)
    usable = documents.select("doc_id", canonical_label(F.col("lang")).alias("label"), "text").where("label is not null and length(text) > 0")
    total = usable.select("label").count()
    keep = min(1.0, train_docs / max(1, total))
    hashed = usable.withColumn("h", F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 30)))
    held = (F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(HELD_OUT)) == 0).cast("int")
    sample = materialize(hashed.where(F.col("h") < int(keep * (1 << 30)) + 1).select("label", "text", held.alias("held")), "language-sample")
    model: Model | None = None
    for turn in range(3):
        shared = spark.sparkContext.broadcast(model)
        counted = sample.mapInArrow(_count(shared, ["lang", "feature", "n"]), "lang int, feature int, n long")
        if turn == 2:
            counted = counted.where("lang = -2")
        rows = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()  # six times FEATURES rows at most
        if turn == 2:
            if len(rows):
                model.steep = STEEP[int(rows.feature.to_numpy()[rows.n.to_numpy().argmin()])]
            break
        counts = np.zeros((len(LANGS), FEATURES))
        own = rows[rows.lang >= 0]
        counts[own.lang.to_numpy(), own.feature.to_numpy()] = own.n.to_numpy()
        bits = rows[rows.lang == -1]
        model = Model(counts)
        if len(bits):
            model.bit_weight = np.full(CODE.shape[1], 1.0, dtype=np.float32)
            model.bit_weight[bits.feature.to_numpy()] = (bits.n / bits.n.max()).to_numpy()
    release(sample)
    return model


def languages(documents: DataFrame, model: Model | None = None, segments: bool = False) -> DataFrame:
    """Languages of each document, or with ``segments`` of each run of segments of one kind in one language.

    Documents: ``doc_id, label, lang, confidence, share, n_langs, ambiguous``, a row per language; ``label`` is the
    language that the stored label names, ``share`` the language's part of the letters.
    Segments: ``doc_id, segment, kind, lang, confidence, n_sentences, ambiguous``. Sentences and parts are runs of one kind,
    ``sentence``; short segments without a clear language belong to the run before, else to the one after.
    """
    spark = documents.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(fit(documents) if model is None else model)  # FEATURES x bits, some 6 MB
    wanted = "doc_id long, label string, lang string, confidence double, share double, n_langs int, ambiguous boolean"
    if segments:
        wanted = "doc_id long, segment int, kind string, lang string, confidence double, n_sentences int, ambiguous boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        names = [x.split()[0] for x in wanted.split(", ")]
        for batch in batches:
            cut = [segments_of(t) for t in batch.column(2).to_pylist()]
            if not segments:
                cut = [_deciding(*x) for x in cut]
            found = [s for own, _, _ in cut for s in own]
            rows: list[tuple] = []
            if found and model.known.any():
                losses = model.losses(model.margins(found))
                best, lead, sure = _order(losses, model.steep)
                docs = [(doc, label, x) for doc, label, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), cut) if x[0]]
                counts = np.array([len(own) for _, _, (own, _, _) in docs])
                if segments:
                    for (doc, _, (_, kinds, of)), end, size in zip(docs, np.cumsum(counts).tolist(), counts.tolist()):
                        at = end - size
                        rows += [(doc, *r) for r in _segment_rows(best[at:end], lead[at:end], sure[at:end], kinds, of)]
                else:
                    sizes = np.array([sum(map(len, s)) + len(s) for s in found])
                    for (doc, label, _), own in zip(docs, _document_rows(losses, best, lead, sure, sizes, counts, model.steep)):
                        rows += [(doc, label, *r) for r in own]
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target)], names=names)

    kinds_of = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}
    target = pa.schema([(x.split()[0], kinds_of[x.split()[1]]) for x in wanted.split(", ")])
    return documents.select("doc_id", canonical_label(F.col("lang")).alias("label"), "text").where("length(text) > 0").mapInArrow(run, wanted)


def _deciding(own: list[list[str]], kinds: list[int], of: list[int]) -> tuple[list[list[str]], list[int], list[int]]:
    """The segments that decide a document's languages: sentences and parts, else all of it as one."""
    kept = [k for k, kind in enumerate(kinds) if kind < 2]
    if kept or not own:
        return [own[k] for k in kept], [kinds[k] for k in kept], [of[k] for k in kept]
    return [[w for words in own for w in words]], [0], [0]


def _document_rows(losses: np.ndarray, best: np.ndarray, lead: np.ndarray, sure: np.ndarray, sizes: np.ndarray, counts: np.ndarray, steep: float) -> list[list[tuple]]:
    """Rows of each document; ``counts`` are its segments, all positive."""
    starts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    clear = lead >= MIN_LEAD
    n = len(LANGS)
    heard = np.bincount(owner[clear] * n + best[clear], minlength=n * len(counts)).reshape(-1, n) > 0
    finite = np.where(np.isfinite(losses), losses, 99.0)
    mean = np.add.reduceat(finite * sizes[:, None], starts, axis=0) / np.add.reduceat(sizes, starts)[:, None]
    one, one_lead, one_sure = _order(mean, steep)
    several = heard.sum(1)
    lang = np.where(several == 1, heard.argmax(1), one)
    out = [[(LANGS[k], s, 1.0, 1, a)] for k, s, a in zip(lang.tolist(), one_sure.tolist(), (one_lead < MIN_LEAD).tolist())]
    for doc in np.flatnonzero(several > 1).tolist():
        own = slice(starts[doc], starts[doc] + counts[doc])
        kept, of, weight = clear[own], best[own], sizes[own]
        total = weight[kept].sum()
        out[doc] = [
            (LANGS[k], float(sure[own][kept & (of == k)].mean()), float(weight[kept & (of == k)].sum() / total), int(several[doc]), False)
            for k in np.flatnonzero(heard[doc])
        ]
    return out


def _segment_rows(best, lead, sure, kinds, of) -> list[tuple]:
    runs: list[list] = []  # kind, language, segments
    waiting: list[int] = []
    for k, kind in enumerate(kinds):
        kind = 0 if kind == 1 else kind
        if kind == 3 and lead[k] < MIN_LEAD and (runs or k + 1 < len(kinds)):
            (runs[-1][2] if runs else waiting).append(k)
        elif runs and runs[-1][:2] == [kind, best[k]]:
            runs[-1][2].append(k)
        else:
            runs.append([kind, best[k], [*waiting, k]])
            waiting = []
    if not runs:
        runs = [[3, best[waiting[0]], waiting]]
    out = []
    for n, (kind, lang, at) in enumerate(runs):
        own = [k for k in at if best[k] == lang]
        out.append((n, KINDS[kind], LANGS[lang], float(sure[own].mean()), len({of[k] for k in at}), bool((lead[own] < MIN_LEAD).any())))
    return out


def wrong_labels(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, lang``: documents in one language with another or no label, and every language of mixed ones."""
    found = languages(documents, model)
    return found.where("n_langs > 1 or label is null or label <> lang").select("doc_id", "lang").distinct()
