"""Personal information in free text: a skip-chain conditional random field over candidate segments."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame

from mnemora.llm.names import deletes, within_one

LABELS = ("none", "email", "phone", "id_number", "address", "name")
#: Hashed features of a segment.
WIDTH = 1 << 15
#: Public people are held in every worker; more of them than this are refused.
MOST_PUBLIC = 200_000
MODEL = Path(__file__).with_name("pii_model.json")
_PLACEHOLDER = {k: f"[{k.upper()}]" for k in LABELS[1:]}

# The ways addresses and forms of address are written in English, German, French and Spanish.
_TITLE = r"(?:Mrs|Mr|Ms|Miss|Dr|Prof|Sir|Dame|Herrn?|Frau|Mme|Mlle|[Ss]e[ñn]or(?:a|ita)?|Sra?|[Dd]on|[Dd]o[ñn]a)\.?"
_CAP = r"\p{Lu}[\p{L}\p{M}\p{Nd}'’]+"
_SUR = rf"{_CAP}(?:-{_CAP})?"
_LINK = r"(?:van|von|der|den|de|la|del|di|da|dos|du|le|ten|ter|zu)"
_TOWN_AFTER = rf"(?:,\s+{_CAP}(?:\s+(?:\d{{4,5}}\b|\p{{Lu}}{{1,2}}\d[\p{{Lu}}\d]?\s+\d\p{{Lu}}{{2}}\b))?)?"
_TOWN_BEFORE = rf"(?:,\s+\d{{4,5}}\s+{_CAP})?"
_MORE = rf"(?:(?:[\s-]{_CAP}){{1,4}}"
_EN = rf"(?:(?:Flat|Unit|Apartment|Apt\.?|Suite)\s+\w+,\s+)?\d+[A-Za-z]?\s+(?:{_CAP}\s+){{1,4}}?(?:Street|St\.|St\b|Road|Rd\.(?=,|\s+\p{{Ll}})|Rd|Lane|Ln|Avenue|Ave|Close|Terrace|Crescent|Drive|Court|Place|Square|Gardens|Way)(?!\w){_TOWN_AFTER}"
_FR = rf"\d+[A-Za-z]?(?:\s+(?:bis|ter))?,?\s+(?:[Rr]ue|[Aa]venue|[Ii]mpasse|[Bb]oulevard|[Pp]lace|[Cc]hemin|[Aa]llée|[Qq]uai)\s+(?:de\s+la\s+|de\s+l['’]|du\s+|des\s+|de\s+|d['’])?{_CAP}{_MORE}(?=,\s+\d{{4,5}}))?{_TOWN_BEFORE}"
_DE = rf"\p{{Lu}}[\p{{L}}]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer)\s+\d+[a-z]?\b{_TOWN_BEFORE}"
_ES = rf"(?:[Cc]alle|C/|[Aa]venida|[Aa]vda\.|[Pp]laza|[Pp]aseo)\s+(?:de\s+la\s+|del\s+|de\s+)?{_CAP}{_MORE}(?=,?\s+\d))?,?\s+\d+[a-z]?\b{_TOWN_BEFORE}"
_STREETS = ("Street", "St.", "St ", "St\n", "Road", "Rd", "Lane", "Ln", "Avenue", "Ave", "Close", "Terrace", "Crescent", "Drive", "Court", "Place", "Square", "Gardens", "Way", "Rue", "rue ", "rue\n", "avenue", "impasse", "Impasse", "oulevard", "place ", "place\n", "hemin", "llée", "quai", "Quai", "alle ", "alle\n", "C/", "venida", "vda.", "laza ", "laza\n", "aseo ", "aseo\n")
_NUMBERED = re.compile(r"(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer)\s+\d")
_DOT = r"(?:\.|\s*[\(\[]\s*dot\s*[\)\]]\s*|\s+dot\s+)"
_EMAIL = rf"(?<![\p{{L}}\p{{Nd}}._%+\-])[\p{{L}}\p{{Nd}}][\p{{L}}\p{{Nd}}._%+\-]*(?:@|\s*[\(\[]\s*at\s*[\)\]]\s*|\s+at\s+(?=[\w\-]+\s+dot\s))[\p{{L}}\p{{Nd}}\-]+(?:{_DOT}[\p{{L}}\p{{Nd}}\-]+)+"
_NUMBER = r"(?<![\p{L}\p{Nd},.\-/])(?:\p{Lu}{2}[\s\-]?(?=\d[\d\s.\-]{5})|\p{Ll}{2}(?=\d{4}))?(?:\+\s?|\()?\d+(?:(?:\s*\(\d+\)\s*|\)\s*|\s+|[.\-/])\d+)*(?:\s?\p{Lu}(?![\p{L}\p{Nd}]))?(?![\p{L}\p{Nd}])"
#: Words that begin a sentence or stand before a name and are no part of it.
_NO_NAME = frozenset("""the a an and or but if between among when while as after before since although because though so then thus now today yesterday tomorrow here there this that these those it he she we you they i
his her its our your their my who what which where why how not no yes in on at by of to for from with without is are was were has have had do does did also only even both each every some many
mr mrs ms miss dr prof sir dame madam madame president commissioner minister witness nurse constituent zeuge zeugin pfleger pflegerin brief herr herrn frau mme mlle señor señora señorita sr sra don doña
le la les un une des du de et ou mais si quand lorsque comme après avant il elle nous vous ils elles je ce cette ces son sa ses notre votre leur qui que où non oui dans sur par pour avec sans est sont
der die das den dem zwischen ein eine einen und oder aber wenn als nach vor seit weil heute gestern hier da dies diese dieser er sie wir ihr es ich sein unser wer was wo nicht nein ja in auf bei von zu für mit ohne ist sind
el los las entre una unos y o pero cuando como después antes ella nosotros ellos yo este esta estos su sus nuestro quien donde no sí en con sin es son hoy ayer""".split())
_WORD = re.compile(r"\w+|[^\w\s]")
_NAME_WORD = regex.compile(_SUR)
# what a name may be made of: titles, initials and capitalised words; "M." before a capital is the French title
_PARTS = regex.compile(rf"(?<![\p{{L}}\p{{Nd}}\-])(?:(?P<t>{_TITLE}(?=\s)|M\.(?=\s+\p{{Lu}}[\p{{L}}]))|(?P<w>{_SUR})(?![\p{{L}}\p{{Nd}}])|(?P<i>\p{{Lu}}\.))")
_JOINED = re.compile(rf"(?=\s)[^\S\n]*(?:\n[^\S\n]*)?(?:{_LINK}\s+)*\Z")  # a blank line parts
_TURN = re.compile(r",\s+\Z")
_LINKED = re.compile(r"\s+(?:von|van)\s")
_AT_SIGN = re.compile(r"[(\[]\s*at\s*[)\]]")
_EMAILS = regex.compile(_EMAIL)
_ADDRESSES = regex.compile(rf"(?<![\p{{L}}\p{{Nd}}])(?:{_EN}|{_FR}|{_DE}|{_ES})")
_NUMBERS = regex.compile(_NUMBER)
#: Digits with what may stand between them; a number lies within one.
_DIGITS = re.compile(r"\d[\d\s().\-/+]{4,}\d")


def _fixed(text: str) -> Iterator[tuple[int, int, int, str]]:
    """Spans of e-mail addresses, addresses and numbers; each pattern is tried only where a cheap sign of its kind stands."""
    if "@" in text or "dot" in text or _AT_SIGN.search(text):
        for m in _EMAILS.finditer(text):
            yield *m.span(), 0, "e"
    if any(w in text for w in _STREETS) or _NUMBERED.search(text):
        for m in _ADDRESSES.finditer(text):
            yield *m.span(), 1, "a"
    end = 0
    for zone in _DIGITS.finditer(text):
        if sum(map(str.isdigit, zone[0])) < 6:
            continue
        at = max(end, zone.start() - 6)  # a sign or two letters may stand before it
        while at < zone.end() and (m := _NUMBERS.search(text, at)) and m.start() < zone.end():
            at = end = m.end()
            if sum(map(str.isdigit, m[0])) >= 6:
                yield *m.span(), 2, "n"


@lru_cache(1 << 16)
def name_parts(s: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Given names and surnames of a name by their place: the last word is the surname, or what stands before a comma; initials are neither."""
    turned = s.split(",")
    words = _NAME_WORD.findall(s)
    if len(words) < 2 and len(turned) < 2:
        return (), tuple(words)
    own = _NAME_WORD.findall(turned[0]) if len(turned) > 1 else words[-1:]
    return tuple(w for w in words if w not in own), tuple(own)


class Segment:
    """A candidate: kind proposed (e, n number, a address, p person), place in the text, features, name tokens."""

    __slots__ = ("kind", "start", "end", "feats", "tokens")

    def __init__(self, kind: str, start: int, end: int) -> None:
        self.kind, self.start, self.end, self.feats, self.tokens = kind, start, end, [], ()


class PublicPeople:
    """Surnames and given names of people whose mention is no personal information."""

    def __init__(self, people: Iterable[tuple[str, str]]) -> None:
        pairs = [(str(g), str(s)) for g, s in people if g and s]
        if len(pairs) > MOST_PUBLIC:
            raise ValueError(f"more than {MOST_PUBLIC} public people")
        self.by_surname: dict[str, set[str]] = {}
        self.index: dict[str, set[str]] = {}
        for g, s in pairs:
            self.by_surname.setdefault(s.lower(), set()).add(g.lower())
            for d in deletes(s.lower()):
                self.index.setdefault(d, set()).add(s.lower())
        self.near = lru_cache(100_000)(self._near)

    def _near(self, surname: str) -> str:
        """'same', 'edit' or 'far': how near a surname is to a public one."""
        s = surname.lower()
        if s in self.by_surname:
            return "same"
        return "edit" if any(within_one(s, x) for d in deletes(s) for x in self.index.get(d, ())) else "far"


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed segments (kind, start, end) in order of their place.

    E-mail addresses, numbers of six digits or more and addresses come from their patterns. People come from runs of
    capitalised words and initials: runs of two or more, single words after a title, names turned by a comma, and bare
    repeats of a surname of the text, also with one edit. No given name or surname need be known. Where it isn't sure
    whether the first word of a sentence belongs to the name, the run is proposed with and without it, and the random
    field decides.
    """
    out: list[tuple[str, int, int]] = []
    taken = [0]  # borders of taken spans in order: a place is taken where an even number of them stand up to it
    for start, end, _, kind in sorted(_fixed(text)):
        if start >= taken[-1]:
            out.append((kind, start, end))
            taken += [start, end]
    inside = lambda at: bisect(taken, at) % 2 == 0
    people: list[tuple[str, int, int]] = []
    singles: list[tuple[str, int, int]] = []
    run: list[tuple[str, int, int]] = []
    turnable: list[tuple[list, list]] = []
    last: list[tuple[str, int, int]] = []

    def close() -> None:
        nonlocal last, run
        if run:
            if len(run) == 1:
                if run[0][0] == "w":
                    singles.append(("p", run[0][1], run[0][2]))
            else:
                _propose(text, run, people, singles)
            if last and text[last[-1][2]] == "," and _TURN.match(text, last[-1][2], run[0][1]):
                turnable.append((last, run))
            last, run = run, []

    end, some = -1, len(taken) > 1
    for m in _PARTS.finditer(text):
        at, to = m.span()
        if some and inside(at):
            close()
            end = -1
            continue
        kind = m.lastgroup
        if kind == "t" and run and run[-1][0] == "w" and text.startswith("M.", at) and _JOINED.match(text, end, at):
            kind = "i"
        if run and (kind == "t" or not _JOINED.match(text, end, at)):
            close()
        run.append((kind, at, to))
        end = to
    close()
    surnames = {w.lower() for _, a, b in people for w in name_parts(text[a:b])[1]}
    free = {a for _, a, _ in singles if turnable}
    for before, after in turnable:
        # a single word ("Brief von" and the like aside), a comma, and one word or initial that no other capital follows
        _, at, to = before[-1]
        if at in free and len(after) <= 2 and after[0][0] != "t" and (after[0][1] in free or after[0][0] == "i") and (len(after) == 1 or after[1][0] == "i"):
            if text[at:to].lower() not in _NO_NAME:
                people.append(("p", at, after[-1][2]))
                free -= {at, after[0][1]}
                surnames.add(text[at:to].lower())
    if surnames:
        index = {d for w in surnames if len(w) >= 5 for d in _cut(w)}
        for kind, a, b in singles:
            w = text[a:b].lower()
            if (not turnable or a in free) and w not in _NO_NAME and (w in surnames or (len(w) >= 5 and not index.isdisjoint(_cut(w)) and any(within_one(w, x) for x in surnames))):
                people.append((kind, a, b))
    return sorted(out + people, key=lambda x: (x[1], -x[2]))


_cut = lru_cache(1 << 16)(deletes)
_BEGINS = re.compile(r"(?:\A|[.!?:;\n\"'»“(–-])\s*\Z")


def _propose(text: str, run: list[tuple[str, int, int]], people: list[tuple[str, int, int]], singles: list[tuple[str, int, int]]) -> None:
    """From a run of parts that stand side by side: the names it may be, or its single word."""
    parts, titled = (run[1:], True) if run[0][0] == "t" else (run, False)
    while len(parts) > 1 and parts[0][0] == "w" and text[parts[0][1] : parts[0][2]].lower() in _NO_NAME:
        parts = parts[1:]
    while parts and parts[-1][0] != "w":
        parts = parts[:-1]
    if not parts:
        return
    # "Brief von Anna Berg": a full name follows
    if not titled and len(parts) > 2 and _LINKED.match(text, parts[0][2], parts[1][1] + 1):
        parts = parts[1:]
    start, end = parts[0][1], parts[-1][2]
    if not titled and len(parts) == 1:
        singles.append(("p", start, end))
        return
    people.append(("p", start, end))
    if not titled and len(parts) > 2 and parts[1][0] == "w" and _BEGINS.search(text, max(0, start - 3), start):
        people.append(("p", parts[1][1], end))


@lru_cache(1 << 16)
def _shape(s: str) -> str:
    return re.sub(r"A+", "A", re.sub(r"a{2,}", "aa", re.sub(r"\s+", " ", re.sub(r"\d", "9", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", s)))))


@lru_cache(1 << 18)
def _hashed(feature: str) -> int:
    return zlib.crc32(feature.encode()) % WIDTH


@lru_cache(1 << 15)
def _around(kind: str, before: tuple[str, ...], after: tuple[str, ...]) -> tuple[int, ...]:
    """Features of the words around a segment, the nearest first."""
    before, after = tuple(map(str.lower, before)), tuple(map(str.lower, after))
    f = [f"k:{kind}"]
    f += [f"b{i}:{kind}:{w}" for i, w in enumerate(before)] + [f"a{i}:{kind}:{w}" for i, w in enumerate(after)]
    f += [f"bb:{kind}:{w}" for w in before] + [f"b2:{kind}:{' '.join(before[:2])}", f"a2:{kind}:{' '.join(after[:2])}"]
    return tuple(map(_hashed, f))


def segments(text: str, public: PublicPeople) -> list[Segment]:
    """The candidate segments of a text, in order, with their features."""
    out = []
    for kind, start, end in candidates(text):
        s = text[start:end]
        seg = Segment(kind, start, end)
        # numbers beside a segment are one word
        before = ["9" if w[-1].isdigit() else w for w in _WORD.findall(text, max(0, start - 40), start)[:-4:-1]]
        after = ["9" if w[-1].isdigit() else w for w in _WORD.findall(text, end, end + 25)[:2]]
        if kind == "n":
            shape = _shape(s)
            digits = sum(map(str.isdigit, s))
            f = (f"s:{shape}", f"d:{digits}", f"s4:{shape[:4]}", f"s6:{shape[:6]}", f"e:{shape[-3:]}", f"lead:{s[:2]}", f"sep:{''.join(sorted(set(shape) - {'9', 'A', 'a'}))}", f"letters:{'A' in shape or 'a' in shape}")
            seg.tokens = (re.sub(r"\W", "", s).lower(),)
        elif kind == "p":
            givens, surnames = name_parts(s)
            nears = [public.near(t) for t in surnames]
            near = "far" if "far" in nears else "edit" if "edit" in nears else "same"
            known = {g for t in surnames for g in public.by_surname.get(t.lower(), ())} if near == "same" else ()
            seg.tokens = tuple(t.lower() for t in surnames)
            form = f"{len(givens)}{len(surnames)}{',' in s}{'.' in s}"
            word = next((w for w in before if w[0].isalpha()), "")
            shouted = len(word) > 1 and word.isupper()
            begins = before[:1] in ([], ["."], ["!"], ["?"], [":"], [")"])
            f = (f"near:{near}:{bool(givens)}", f"form:{form}", f"form:{form}:{near}", f"upper:{s.split()[-1].isupper()}:{shouted}", f"shouted:{shouted}:{form}", f"own:{near}:{any(g.lower() in known for g in givens)}", f"begins:{begins}:{form}",
                 f"w1:{givens[0].lower()}" if begins and givens else "w1", f"tail:{surnames[-1][-3:].lower()}" if surnames else "tail")
        else:
            f = (f"s:{kind}:{_shape(s)[:12]}", f"digits:{kind}:{any(map(str.isdigit, s))}", f"comma:{kind}:{s.count(',')}")
        seg.feats = [*_around(kind, tuple(before), tuple(after)), *map(_hashed, f)]
        out.append(seg)
    return out


_ALLOWED = {"e": (0, 1), "n": (0, 2, 3), "a": (0, 4), "p": (0, 5)}


def _mask(kind: str) -> np.ndarray:
    m = np.full(len(LABELS), -1e9)
    m[list(_ALLOWED[kind])] = 0
    return m


_MASKS = {k: _mask(k) for k in _ALLOWED}
_KINDS = {k: i for i, k in enumerate(_MASKS)}
_MASK_ROWS = np.stack(list(_MASKS.values()))
#: Potential of two segments that overlap: not both of them are anything.
_ONE_OF = np.where(np.arange(len(LABELS))[:, None] * np.arange(len(LABELS))[None, :] > 0, -30.0, 0.0)


def overlaps(segs: list[Segment]) -> list[tuple[int, int]]:
    """Neighbours that overlap, of which at most one is anything."""
    return [(i, i + 1) for i in range(len(segs) - 1) if segs[i].end > segs[i + 1].start]


def edges(segs: list[Segment]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between neighbours that don't overlap, and skip edges: each repeated or similar token's mentions, one to the next.

    Mentions that share a token, or name tokens one edit apart, are linked in order of place to the last mention before.
    """
    line = [(i, i + 1) for i in range(len(segs) - 1) if segs[i].end <= segs[i + 1].start]
    last: dict[tuple[str, str], int] = {}
    near: dict[str, dict[str, int]] = {}
    skip = set()
    for i, s in enumerate(segs):
        for t in s.tokens:
            key = (s.kind, t)
            if key in last and last[key] != i:
                skip.add((last[key], i))
            last[key] = i
            if s.kind == "p" and len(t) >= 4:
                cut = _cut(t)
                like = [j for d in cut for x, j in near.get(d, {}).items() if x != t and j != i and within_one(t, x)]
                if like:
                    skip.add((max(like), i))
                for d in cut:
                    near.setdefault(d, {})[t] = i
    return line, sorted(skip)


class Model:
    """Weights: features x labels, chain labels x labels, skip labels x labels. No words of names are kept but those that begin sentences and the last letters of surnames, hashed."""

    def __init__(self, node: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> None:
        self.node, self.chain, self.skip = node, chain, skip

    @staticmethod
    def load(path: Path | str = MODEL) -> Model:
        d = json.loads(Path(path).read_text())
        node = np.zeros((WIDTH, len(LABELS)))
        for i, row in zip(d["features"], d["weights"]):
            node[i] = row
        return Model(node, np.array(d["chain"]), np.array(d["skip"]))

    def save(self, path: Path | str = MODEL) -> None:
        used = np.flatnonzero(np.abs(self.node).max(axis=1) > 0.02)
        Path(path).write_text(json.dumps({
            "features": used.tolist(), "weights": np.round(self.node[used], 2).tolist(), "chain": np.round(self.chain, 3).tolist(), "skip": np.round(self.skip, 3).tolist()}))

    def infer(self, docs: list[list[Segment]], rounds: int = 8) -> list[np.ndarray]:
        """Labels of the segments of many documents at once, by loopy sum-product message passing."""
        sizes = [len(d) for d in docs]
        n, k = sum(sizes), len(LABELS)
        if not n:
            return [np.zeros(0, int) for _ in docs]
        flat = [s for d in docs for s in d]
        lengths = np.fromiter((len(s.feats) for s in flat), np.int64, n)
        feats = np.fromiter(chain.from_iterable(s.feats for s in flat), np.int64, int(lengths.sum()))
        local = np.add.reduceat(self.node[feats], np.r_[0, np.cumsum(lengths)[:-1]], axis=0) + _MASK_ROWS[np.fromiter((_KINDS[s.kind] for s in flat), np.int64, n)]
        src, dst, kind, at = [], [], [], 0
        for d in docs:
            for which, pairs in enumerate((*edges(d), overlaps(d))):
                for i, j in pairs:
                    src += [at + i, at + j]
                    dst += [at + j, at + i]
                    kind += [2 * which, 2 * which + 1]
            at += len(d)
        belief = local
        if src:
            src, dst, kind = np.array(src), np.array(dst), np.array(kind)
            table = np.stack([self.chain, self.chain.T, self.skip, self.skip.T, _ONE_OF, _ONE_OF])[kind]
            back = np.arange(len(src)) ^ 1
            message = np.zeros((len(src), k))
            for _ in range(rounds):
                belief = local.copy()
                np.add.at(belief, dst, message)
                out = (belief[src] - message[back])[:, :, None] + table
                top = out.max(axis=1, keepdims=True)
                new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
                new -= new.max(axis=1, keepdims=True)
                step = 0.5 * (new - message)
                message = message + step
                if np.abs(step).max() < 1e-3:
                    break
            belief = local.copy()
            np.add.at(belief, dst, message)
        return np.split(belief.argmax(axis=1), np.cumsum(sizes)[:-1])


def fit(docs: list[list[Segment]], gold: list[np.ndarray], epochs: int = 12, rate: float = 0.2, decay: float = 1e-5, seed: int = 0) -> Model:
    """Pseudo-likelihood training: each segment's label given its features and the true labels of its neighbours."""
    k = len(LABELS)
    m = Model(np.zeros((WIDTH, k)), np.zeros((k, k)), np.zeros((k, k)))
    sums = [np.full(w.shape, 1e-6) for w in (m.node, m.chain, m.skip)]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for d in rng.permutation(len(docs)):
            segs, y = docs[d], gold[d]
            pairs = edges(segs)
            near: list[list[tuple[int, int, bool]]] = [[] for _ in segs]
            for which, es in enumerate(pairs):
                for i, j in es:
                    near[i].append((which, j, True))
                    near[j].append((which, i, False))
            for i, s in enumerate(segs):
                score = m.node[s.feats].sum(axis=0) + _MASKS[s.kind]
                for which, j, forward in near[i]:
                    w = m.skip if which else m.chain
                    score = score + (w[:, y[j]] if forward else w[y[j]])
                p = np.exp(score - score.max())
                p /= p.sum()
                p[y[i]] -= 1
                if np.abs(p).max() < 1e-3:
                    continue
                sums[0][s.feats] += p * p
                m.node[s.feats] -= rate * p / np.sqrt(sums[0][s.feats]) + decay * m.node[s.feats]
                for which, j, forward in near[i]:
                    w, g = (m.skip, sums[2]) if which else (m.chain, sums[1])
                    at = (slice(None), y[j]) if forward else (y[j], slice(None))
                    g[at] += p * p
                    w[at] -= rate * p / np.sqrt(g[at])
    return m


def _spans(texts: list[str], public: PublicPeople, model: Model) -> Iterator[list[tuple[str, int, int]]]:
    docs = [segments(t or "", public) for t in texts]
    for segs, y in zip(docs, model.infer(docs)):
        at, out = 0, []
        for s, k in zip(segs, y):
            if k and s.start >= at:
                out.append((LABELS[k], s.start, s.end))
                at = s.end
        yield out


def _each(public_people: Iterable[tuple[str, str]], model_path: str):  # noqa: ANN202
    """A function from a text column to its texts and the spans found in each, a part at a time."""
    people = list(public_people)
    model = Model.load(model_path)  # sent along, as a path of the driver may not be there on executors
    # one of each in a process: their caches outlive a batch
    made: list[PublicPeople] = []

    def run(texts: pa.Array) -> Iterator[tuple[int, str | None, list[tuple[str, int, int]]]]:
        if not made:
            made.append(PublicPeople(people))
        for s in range(0, len(texts), 500):
            part = texts.slice(s, 500).to_pylist()
            for i, (t, spans) in enumerate(zip(part, _spans(part, made[0], model))):
                yield s + i, t, spans

    return run


def find_pii(docs: DataFrame, doc_id: Column, text: Column, public_people: Iterable[tuple[str, str]], model_path: str = str(MODEL)) -> DataFrame:
    """Distinct personal information of each document: doc_id, kind, pii_text (runs of white space as one blank).

    Patterns propose segments with their borders; the random field labels them, each document as a whole: neighbours
    share potentials, and so do segments that repeat a name or number, however far apart. ``public_people`` (given
    name, surname; a bounded list) are no personal information. Null and empty texts give no rows; texts are taken
    whole. Rows with one id are taken together.
    """
    rows = docs.select(doc_id.alias("doc_id"), text.cast("string").alias("text")).where("text IS NOT NULL")
    each = _each(public_people, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, kinds, found = [], [], []
            for i, t, spans in each(b.column(1)):
                for k, start, end in dict.fromkeys(spans):
                    at.append(i)
                    kinds.append(k)
                    found.append(" ".join(t[start:end].split()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(kinds, pa.string()), pa.array(found, pa.string())], ["doc_id", "kind", "pii_text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, kind string, pii_text string").distinct()


def redact(docs: DataFrame, doc_id: Column, text: Column, public_people: Iterable[tuple[str, str]], model_path: str = str(MODEL)) -> DataFrame:
    """Each document with its personal information replaced by typed placeholders: doc_id, text. Null stays null."""

    rows = docs.select(doc_id.alias("doc_id"), text.cast("string").alias("text"))
    each = _each(public_people, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[str | None] = []
            for _, t, spans in each(b.column(1)):
                parts, at = [], 0
                for k, start, end in spans:
                    parts += [t[at:start], _PLACEHOLDER[k]]
                    at = end
                out.append(None if t is None else "".join([*parts, t[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
