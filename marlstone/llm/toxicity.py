"""Scores for abusive, hateful and sexual content by compression distance.

Texts are cut into windows (sentences), whose spelling tricks are undone: look-alike letters, digits for letters, letters
set apart, drawn-out letters, invisible characters, accents. One zstandard dictionary is trained on ordinary windows
and one per category on offending ones. A window is offending by the bytes it saves under a category's dictionary
against the ordinary one, per byte of window; thresholds are calibrated on labelled documents that were held out.

Reviewers label documents, not windows, and err. Training therefore starts from the windows of reported documents that
the ordinary dictionary explains badly, and re-assigns windows between the dictionaries in rounds, each time with
dictionaries that have not seen the window.
"""

from __future__ import annotations

import html
import pickle
import re
import unicodedata
import zlib
from collections.abc import Iterator
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.markup import _TAG as TAG

CATEGORIES = ("abusive", "hateful", "sexual")
#: Most labelled documents that training looks at, of reported and of ordinary ones; taken by a hash of the id.
MAX_REPORTED, MAX_ORDINARY = 6000, 6000
DICT_BYTES, FOLDS, ROUNDS = 262144, 4, 2
#: Level of compression that decides, a level that is much quicker, and the gain per byte under which a window is left to the
#: latter; decisions are made from LEAST upwards.
LEVEL, QUICK, SCREEN = 19, 3, 0.04
#: Most windows a dictionary is trained on (they come in random order), and the length of its segments.
MAX_WINDOWS, SEGMENT = 30_000, 96
#: Shortest and longest window in characters, and how many two cut from one sentence share, more than an offending phrase
#: usually has; bytes added to a window's length, as short ones say little.
SHORT, LONG, SHARED, PAD = 24, 300, 100, 20
#: Gains per byte: to stay a training window, and the range of calibrated thresholds. How much oftener reported documents
#: hold a telling word pair.
KEEP, LEAST, DEFAULT, MOST, TELLING = 0.1, 0.12, 0.15, 0.18, 5

# Cyrillic and Greek letters that look like Latin ones.
_LOOKS = dict(zip("асеорхуіјѕһкмтвнԁαοερυι", "aceopxyijshkmtbhdaoepui"))
_TO_LATIN = str.maketrans(_LOOKS)
_TO_CYRILLIC = str.maketrans({"a": "а", "c": "с", "e": "е", "o": "о", "p": "р", "x": "х", "y": "у", "k": "к", "m": "м", "t": "т", "b": "в", "h": "н"})
# Digits and signs written for letters.
_LEET = str.maketrans("0134578@$", "oieastbas")
_APART = re.compile(r"(?<!\w)(?:[^\W\d_]([ \t.*_\-·])(?:[^\W\d_]\1){1,}[^\W\d_])(?!\w)")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
_TOKEN = re.compile(r"[\w@$]+")
_MARKED = re.compile(r"[^\W\d]*[\d@$][\w@$]*")
_LATIN, _OTHER = re.compile(r"[^\W\d_\u0250-\U0010ffff]"), re.compile(r"[^\W\d_\x00-\u024f]")
_UNSEEN = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_END = re.compile(r"(?<=[.!?…。！？])[\"'’”»)\]]*\s+|\s*\n[^\S\n]*\n\s*")
_LINE = re.compile(r"[\n\r\x0b\x0c\x85\u2028\u2029]+")
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\s]*\)")
_URL = re.compile(r"https?://\S+")
# Attributes of a tag: each has a value, so that words between angle brackets are none.
_ATTRS = re.compile(r"(?:\s+[A-Za-z_:@][\w:.-]*\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))*\s*/?\s*")
_ALT = re.compile(r"\salt\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(\S+))", re.I)


class _Visible(dict):
    """Code points as they are, None for marks, format and control characters; learnt as they come."""

    def __missing__(self, point: int) -> int | None:
        c = chr(point)
        self[point] = None if unicodedata.category(c) in ("Mn", "Cf", "Cc") and c not in "\t\n\r" else point
        return self[point]


_VISIBLE = _Visible()


def _token(m: re.Match) -> str:
    w = m.group()
    letters = [c for c in w if c.isalpha()]
    if not letters:
        return "0" if w[0].isdigit() else w
    latin = [c for c in letters if c < "ɐ"]
    if latin and len(latin) < len(letters):  # letters of two alphabets: the one all of whose strangers have a look-alike
        to_latin = all(c < "ɐ" or c in _LOOKS for c in letters)
        to_cyrillic = all(ord(c) in _TO_CYRILLIC for c in latin)
        more_latin = 2 * len(latin) >= len(letters)
        w = w.translate(_TO_LATIN if to_latin and (more_latin or not to_cyrillic) or more_latin and not to_cyrillic else _TO_CYRILLIC)
    if any(c.isdigit() or c in "@$" for c in w):
        w = w.translate(_LEET)
    return w


def _visible(m: re.Match) -> str:
    """A space for an HTML tag, the text of an image for its tag; anything else between angle brackets stays."""
    if not _ATTRS.fullmatch(m["attrs"] or ""):
        return m.group()
    alt = m["name"].lower() == "img" and _ALT.search(m["attrs"] or "")
    return f" {next((x for x in alt.groups() if x), '')} " if alt else " "


def normalise(text: str) -> str:
    """Lower-case text with the usual disguises of words undone and numbers reduced to 0; of links and images the label."""
    if "<" in text:
        text = TAG.sub(_visible, text)
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _LINK.sub(r" \1 ", text)
    if "://" in text:
        text = _URL.sub(" ", text)
    if text.isascii():
        text = _UNSEEN.sub("", text)
    else:
        text = unicodedata.normalize("NFKD", text).translate(_VISIBLE)
    text = _APART.sub(lambda m: m.group().replace(m[1], ""), text.lower())
    # a word needs a look only if it has digits or signs, or letters of two alphabets
    mixed = not text.isascii() and _OTHER.search(text) and _LATIN.search(text)
    text = (_TOKEN if mixed else _MARKED).sub(_token, text)
    return " ".join(_RUN.sub(r"\1", text).split())


def _cut(plain: str) -> Iterator[str]:
    """A long sentence in windows that begin and end at spaces, where it has any, and overlap."""
    at = 0
    while len(plain) - at > LONG:
        end = plain.rfind(" ", at + LONG // 2, at + LONG + 1)
        end = end if end >= 0 else at + LONG
        yield plain[at:end]
        # the shared part begins with a whole word
        back = plain.rfind(" ", max(at + SHARED // 4, end - SHARED - SHARED // 2), end - SHARED)
        at = back + 1 if back >= 0 else end - SHARED
    yield plain[at:]


def windows(text: str) -> list[bytes]:
    """Normalised sentences of the whole text; very long ones are cut with an overlap, very short ones join the next."""
    out: list[bytes] = []
    held = ""
    pieces = [x for p in _END.split(text) for x in (_LINE.split(p) if len(p) > LONG else (p,))]
    for piece in pieces:
        if not piece or not piece.strip():
            continue
        held = f"{held} {piece}" if held else piece
        if len(held.strip()) < SHORT:
            continue
        plain, held = normalise(held), ""
        out += [x.encode() for x in _cut(plain)]
    if held.strip():
        out.append(normalise(held).encode())
    return [w for w in out if w]


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on the samples; where they are too few to train on, the samples themselves are the dictionary."""
    if not samples:
        return None
    samples = samples[:MAX_WINDOWS]
    total = sum(map(len, samples))
    if len(samples) >= 100 and total > 8192:
        try:
            return zstandard.train_dictionary(min(DICT_BYTES, total), samples, k=SEGMENT, d=8, level=3)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"\n".join(samples)[-DICT_BYTES:].rjust(8, b"\n"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class _Gauge:
    """Compressed lengths under one dictionary."""

    def __init__(self, dictionary: zstandard.ZstdCompressionDict | None, level: int = LEVEL):
        options = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if dictionary:
            dictionary.precompute_compress(level=level)
        self.press = zstandard.ZstdCompressor(dict_data=dictionary, **options) if dictionary else zstandard.ZstdCompressor(**options)

    def __call__(self, window: bytes) -> int:
        return len(self.press.compress(window))


class _Gauges:
    """Gains per byte of a window under each of several dictionaries against the first. Most windows gain nothing near a threshold at
    the quick level and are not compressed again at the thorough one."""

    def __init__(self, dictionaries: list[tuple[bytes, int] | None]):
        def load(level: int) -> list[_Gauge]:
            # a dictionary holds the tables of one level, so each level has its own
            return [_Gauge(zstandard.ZstdCompressionDict(d[0], dict_type=d[1]) if d else None, level) for d in dictionaries]

        self.quick, self.thorough = load(QUICK), load(LEVEL)

    def __call__(self, window: bytes) -> list[float]:
        size = len(window) + PAD
        for gauges in (self.quick, self.thorough):
            base = gauges[0](window)
            gains = [(base - g(window)) / size for g in gauges[1:]]
            if not gains or max(gains) < SCREEN:
                break
        return gains


def _packed(d: zstandard.ZstdCompressionDict | None) -> tuple[bytes, int] | None:
    data = d.as_bytes() if d else b""
    return (data, zstandard.DICT_TYPE_FULLDICT if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT) if data else None


@dataclass
class Model:
    #: dictionaries of ordinary and, in the order of ``names``, of offending windows
    dictionaries: list[tuple[bytes, int] | None]
    names: list[str]
    thresholds: dict[str, float]
    report: dict[str, float] = field(default_factory=dict)

    def gauges(self) -> _Gauges:
        return _Gauges(self.dictionaries)


def document_scores(text: str | None, gauges: _Gauges, names: list[str]) -> dict[str, float]:
    """Per category the largest gain of a window that no other category explains better; -1 for none."""
    best = dict.fromkeys(CATEGORIES, -1.0)
    for w in windows(text) if text and names else []:
        gains = gauges(w)
        k = int(np.argmax(gains))
        best[names[k]] = max(best[names[k]], gains[k])
    return best


def _labels(votes: list[tuple[str, str]]) -> frozenset[str]:
    return frozenset(c for _, c in votes if c in CATEGORIES)


def _fold(doc: int) -> int:
    return zlib.crc32(str(doc).encode()) % FOLDS


def _seeds(rows: list[tuple[int, frozenset[str], bytes]], names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A first kind for every window: 0, or 1 + the category whose reported documents hold most of its telling word
    pairs; and whether it holds many of them, reported or not. A pair is telling if two or more reported documents
    hold it, and reported ones far oftener than others."""
    held: dict[bytes, dict[int, frozenset[str]]] = defaultdict(dict)
    pairs = []
    for doc, labels, w in rows:
        words = w.split()
        own = {a + b" " + b for a, b in zip(words, words[1:])}
        pairs.append(own)
        for p in own:
            held[p][doc] = labels
    documents = {d: labels for d, labels, _ in rows}
    told = sum(1 for x in documents.values() if x)
    share = told / max(1, len(documents) - told)
    tells: dict[bytes, np.ndarray] = {}
    for p, docs in held.items():
        t = sum(1 for x in docs.values() if x)
        if t >= 2 and t > TELLING * share * (len(docs) - t) + 1:
            tells[p] = np.array([sum(c in x for x in docs.values()) for c in names], float)
    base = np.array([sum(c in x for x in documents.values()) for c in names], float)
    kind, suspect = np.zeros(len(rows), int), np.zeros(len(rows), bool)
    for i, own in enumerate(pairs):
        found = [tells[p] for p in own if p in tells]
        suspect[i] = len(found) >= max(2, 0.25 * len(own))
        if suspect[i] and rows[i][1]:
            odds = np.sum([np.log((f + 0.3) / (base + 1)) for f in found], 0)
            odds[[c not in rows[i][1] for c in names]] -= 2
            kind[i] = 1 + int(np.argmax(odds))
    return kind, suspect


def train(documents: list[tuple[int, str, frozenset[str]]]) -> Model:
    """Fit on (doc_id, text, reported categories); an empty set means that all reviewers found nothing."""
    rows = [(doc, labels, w) for doc, text, labels in documents if text for w in windows(text)]
    text = [w for _, _, w in rows]
    names = [c for c in CATEGORIES if any(c in labels for _, labels, _ in rows)]
    fold = np.array([_fold(d) for d, _, _ in rows], int)
    told = np.array([bool(labels) for _, labels, _ in rows], bool)
    order = np.random.default_rng(11).permutation(len(rows))

    def held_out(sides: list[np.ndarray]) -> np.ndarray:
        """Gains of every window under the dictionaries of the sides after the first, none of which has seen the window's document."""
        out = np.zeros((len(rows), len(sides) - 1))
        for f in range(FOLDS):
            gauges = _Gauges([_packed(_dictionary([text[i] for i in order if side[i] and fold[i] != f])) for side in sides])
            for i in np.flatnonzero(fold == f):
                out[i] = gauges(text[i])
        return out

    kind, suspect = _seeds(rows, names)
    each = np.full((len(rows), len(names)), -1.0)
    gain = np.full(len(rows), -1.0)
    for _ in range(ROUNDS if names else 0):
        clean = ~told & ~suspect
        each = held_out([clean, *[kind == 1 + k for k in range(len(names))]])
        gain, best = each.max(1), each.argmax(1)
        kind = np.where(told & (gain > np.where(suspect, 0, KEEP)), 1 + best, 0)
    thresholds, report = {}, {}
    for k, c in enumerate(names):
        top: dict[int, float] = {}
        for i in np.flatnonzero(each.argmax(1) == k):
            top[rows[i][0]] = max(top.get(rows[i][0], -1.0), each[i, k])
        truth = {d: c in labels for d, labels, _ in rows}
        found, total, best_f, at = 0, sum(truth.values()), 0.0, DEFAULT
        for n, d in enumerate(sorted(top, key=lambda d: (-top[d], d)), 1):
            found += truth[d]
            if 2 * found / (n + total) > best_f:
                best_f, at = 2 * found / (n + total), top[d]
        thresholds[c], report[c] = float(min(max(at, LEAST), MOST)), best_f
    clean = ~told & ~suspect
    final = [_packed(_dictionary([text[i] for i in order if side[i]])) for side in [clean, *[kind == 1 + k for k in range(len(names))]]]
    held = [k for k, d in enumerate(final[1:]) if d]
    return Model([final[0], *[final[1 + k] for k in held]], [names[k] for k in held], thresholds, report)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, found) of a bounded sample of labelled documents for training: at most ``MAX_REPORTED`` + ``MAX_ORDINARY`` of
    them. The newest label of a reviewer for a document counts, repeated rows once."""
    known = labels.filter(F.col("category").isin(*CATEGORIES, "none") & F.col("doc_id").isNotNull())
    last = known.groupBy("doc_id", "reviewer").agg(F.max(F.struct("reviewed_at", "category")).alias("last"))
    votes = last.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("last.category") != "none", F.col("last.category")))).alias("found"))
    reported, calm = votes.filter(F.size("found") > 0), votes.filter(F.size("found") == 0)
    chosen = reported.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_REPORTED).unionByName(calm.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ORDINARY))
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")  # bounded by the two limits
    return texts.groupBy("doc_id").agg(F.max("text").alias("text"), F.first("found").alias("found"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trained in a task on an executor; only the model, four dictionaries of at most ``DICT_BYTES``, comes to the driver."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((d, t, frozenset(c)) for part in parts for d, t, c in zip(*(x.to_pylist() for x in part.columns)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows))], pa.binary())], names=["model"])

    model = labelled(docs, labels).select("doc_id", "text", "found").repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(model[0]) if model else train([])  # no task runs over what is known to be empty


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a score per category and ``offends``, the array of categories at or over their thresholds.

    Every window of the whole text counts. Null, empty and blank texts score -1 everywhere and offend in nothing. Rows are
    independent: no shuffle; repeated rows come out repeated; columns of ``docs`` named like an output are replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # four dictionaries of at most DICT_BYTES
    memory: dict[int, _Gauges] = {}
    names = model.names

    @F.arrow_udf("struct<abusive:double,hateful:double,sexual:double>")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if 0 not in memory:
            memory[0] = pickle.loads(shipped.value).gauges()
        kind = pa.struct([(c, pa.float64()) for c in CATEGORIES])
        for texts in batches:
            yield pa.array([document_scores(t, memory[0], names) for t in texts.to_pylist()], kind)

    new = [f"{c}_score" for c in CATEGORIES] + ["offends"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    found = docs.select(*kept, scores("text").alias("__s"))
    each = [F.when(F.col(f"__s.{c}") >= model.thresholds.get(c, 9.0), F.lit(c)) for c in CATEGORIES]
    return found.select(*kept, *[F.col(f"__s.{c}").alias(f"{c}_score") for c in CATEGORIES], F.array_compact(F.array(*each)).alias("offends"))
