"""Sentence units with their positions, in markdown texts of many languages and scripts.

A text is cut into blocks first: front matter and fenced code have no units, a heading or a list item is
one unit, and what stands between blank lines is a paragraph, whatever its line breaks. Within a paragraph
every mark that could end a sentence is a gap with one or more nodes (before or after closing emphasis); a
node's evidence may be for an end or against it. An edge of this lattice is a unit from one node to a later
one; it costs if emphasis opens in it and does not close, or if it is nothing but an abbreviation. The
cheapest path, that is the one with most evidence after costs, gives the units.

In scripts with spaces the evidence at a node is the mark, the word before it (abbreviations, initials,
ordinals, file names) and the opening of what follows. In scripts without spaces (Japanese, Chinese, Thai)
the runs on both sides of a gap are segmented by dictionary word lattices (``spaceless``), and the gap
classified by the final particle or ending before it and the opening word after it. Pairs of quotes and
brackets are matched first: marks within a pair split only where the pair is a sentence of its own.

Null and empty texts have no units, nor have blocks without letters or digits. Positions count code
points from 0; the end is exclusive; blanks at the ends are outside, closing marks inside.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import rx
from ledgerloom.llm.spaceless import BLANK, ELLIPSIS, FULL, UNOPENED, VOCABULARY, Lattices, plain_lattices, vocabulary_words

# Abbreviations after which a sentence goes on (titles, references, "for example").
NEVER_LAST = set(
    "dr mr mrs ms prof sgt capt lt col gen rev hon st mt fr vs v cf ca approx no nos nr vol vols bd pp p pg fig figs art sec ch ed eds viz resp al i.e e.g z.b d.h u.a s.o s.u vgl bzw ggf evtl inkl abs kap tel hr fr frau str "
    "sr sra srta dra d dña ud uds pág págs fig núm n.º cap aprox p.ej ej p.ex ex env mme mlle mm me m mgr éd chap "
    "см рис стр т.е гл им ул г-н г-жа напр ср "
    "κ κα κος αρ δηλ π.χ βλ σελ κεφ "
    "د أ م ص डॉ सं श्री पृ jan feb mar apr jun jul aug sep sept oct nov dec".split()
)
# Abbreviations that may also end a sentence; the next word's case tells.
MAYBE_LAST = set("etc usw co inc ltd corp jr a.m p.m u.s т.д т.п г гг др и др u.s.w bros dept κ.λπ κλπ κ.ά".split())
MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jan|Feb|Jahrhundert|Stock|Klasse|Auflage"
SPEECH = (
    "asked said shouted cried called replied answered whispered wrote added noted murmured "
    "fragte sagte rief schrie antwortete flüsterte demanda cria dit répondit demande crie lança "
    "preguntó dijo gritó exclamó respondió спросил спросила сказал сказала крикнул крикнула ответил ответила "
    "ρώτησε είπε φώναξε απάντησε पूछा कहा बोला बोली चिल्लाया قال قالت سأل صاح"
).split()

# Openings by which a sentence goes on after a quotation, in Arabic.
AR_RUNS_ON = r"ثم\b|ف\p{L}|و\p{L}"

# Words that begin a sentence after a single letter ("plan B. Then ...").
OPENERS = set(
    "the this that these it he she they we you i but and then there a an in on at after before when if no "
    "der die das er sie es wir ich dann aber und im am danach le la les il elle ils nous on puis mais ce cette ensuite "
    "el los las ella ello nosotros pero luego entonces он она они оно мы это но потом затем в".split()
)

_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉", "“": "”", "„": "“", "‚": "‘", "‘": "’", "«": "»", "‹": "›"}
_OPENERS = {b: "".join(a for a in _PAIRS if _PAIRS[a] == b) for b in _PAIRS.values()}
_CLOSERS = set(_PAIRS.values()) | {'"', "'", "»", "”"}
_BRACKETS = set("([{（［【《〈")
_ENDS = set(".!?…。！？．؟।॥｡۔።។။༎")
_QUOTE = regex.compile("[" + regex.escape("".join(sorted({*_PAIRS, *_CLOSERS}))) + "]")
_MARK = regex.compile(r"[.!?…。！？．؟।॥｡۔።။។༎;;]")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_KANA = regex.compile(r"[\p{Hiragana}\p{Katakana}]")
_GREEK = regex.compile(r"\p{Greek}")
_OTHER = regex.compile(r"[\p{L}--\p{Greek}]", regex.V1)
_WORDY = regex.compile(r"[\p{L}\p{N}]")
_FILE = regex.compile(r"[\p{L}\p{N}_]+(?:[-_./][\p{L}\p{N}_]+)*\.(?:md|txt|html?|json|ya?ml|py|csv|markdown|pdf)\b|[\w-]+\d[\w-]*\.\w+")
_THAI_GAP = regex.compile(r"(?<=\p{Thai}) +(?=\p{Thai})")
_CLAUSE_END = regex.compile(r"[.!?。！？؟।]")
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
# Looked for backwards from a place; ``match(s, from, place)``.
_LAST_WORD = regex.compile(r"(?r)[^\s()\[\]«»“”„\"'’‘「」（）,;:—–]+")
_LAST_CJK = regex.compile(r"(?r)[\p{Han}\p{Hiragana}\p{Katakana}ー々]+")
_LAST_THAI = regex.compile(r"(?r)\p{Thai}+")
_LAST_LETTERS = regex.compile(r"(?r)[\p{L}\p{M}]+")
_LAST_PAIR = regex.compile(r"(?r)(?<!\p{L})(\p{L}{1,2})\. ?(\p{L}{1,2})")
_INNER = regex.compile(r"(?r)[.!?…。！？．؟।॥｡۔።။។༎;;]\s*[\"'”’»」』“）)\]]*")
# Looked for onwards from a place.
_CJK_RUN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々]+")
_THAI_RUN = regex.compile(r"\p{Thai}+")
_LEAD = regex.compile(r"[\s\p{P}\p{S}]*")
_NEXT_WORD = regex.compile(r"\s+(\p{L}+)")
_BLANKS = regex.compile(r"\s*")
_TOKEN = regex.compile(r"\S*")
_PAUSE = regex.compile(r"\s*[,،;:、，—–-]")
_CJK_OPENS = regex.compile(r"\s*[「『“（(]")
_AR_ON = regex.compile(rf"\s*(?:{AR_RUNS_ON})")
_MONTH = regex.compile(rf"\s+(?:{MONTHS})\b")
_PAGE = regex.compile(r"\S*\.(?:md|txt|html?)\b")
_OWN = regex.compile(r"[ *_]*")
_EMPHASIS = regex.compile(r"\*\*|\*|__|_")
_STARS = {"*": 1, "**": 2, "_": 4, "__": 8}
#: Costs of an edge: emphasis that opens in a unit and does not close there, a unit that is an abbreviation only.
OPEN_COST, SHORT_COST = 0.75, 5.0


def blocks(text: str) -> Iterator[tuple[list[tuple[int, int]], bool]]:
    """Blocks of a markdown text: spans of their lines without markers, and whether the block is one unit."""
    n, at = len(text), 0
    m = rx.match(r"\A---[ \t]*\r?\n(?:.*?\r?\n)??---[ \t]*(?:\r?\n|\Z)", text, regex.S)
    if m:
        at = m.end()
    lines: list[tuple[int, int]] = []
    single, fence, in_list = False, "", False
    while at < n:
        stop = text.find("\n", at)
        stop = n if stop < 0 else stop
        line = text[at:stop]
        here, at = at, stop + 1
        f = rx.match(r"[ >]*(`{3,}|~{3,})", line) if "```" in line or "~~~" in line else None
        if fence:
            if f and f[1][0] == fence[0] and len(f[1]) >= len(fence) and not line[f.end() :].strip():
                fence = ""
            continue
        if f:
            if lines:
                yield lines, single
            lines, single, in_list, fence = [], False, False, f[1]
            continue
        skip = 0 if line[:1].isalnum() else rx.match(r"\s*(?:>\s?)*\s*", line).end()
        rest = line[skip:]
        first = rest[:1]
        quoted = ">" in line[:skip]
        if not rest.strip() or (first in "-*_" and rx.fullmatch(r"([-*_])(?:[ \t]*\1){2,}\s*", rest)):
            if lines:
                yield lines, single
            lines, single = [], False
            in_list = in_list and not quoted and not rest.strip()
            continue
        head = rx.match(r"#{1,6}(?:[ \t]+|$)", rest) if first == "#" else None
        item = rx.match(r"(?:[-*+]|(\d{1,9})[.)])[ \t]+", rest) if first in "-*+" or first.isdigit() else None
        if item and item[1] and lines and not single and item[1] != "1":
            item = None  # a wrapped line that begins with a number
        if head or item:
            if lines:
                yield lines, single
            box = rx.match(r"\[[ xX]\][ \t]+", rest[item.end() :]) if item else None
            skip += (head or item).end() + (box.end() if box else 0)
            lines = [(here + skip, stop)]
            single, in_list = True, bool(item)
            if head:
                yield lines, True
                lines, single = [], False
            continue
        lines.append((here + skip, stop))
    if lines:
        yield lines, single


def _matched(s: str) -> list[tuple[int, int]]:
    """Outermost matched pairs of quotes and brackets: (opening, closing)."""
    stack: list[tuple[str, int]] = []
    depth: dict[str, list[int]] = {}  # where each opener is on the stack
    found: list[tuple[int, int]] = []
    n = len(s)

    def push(c: str, i: int) -> None:
        depth.setdefault(c, []).append(len(stack))
        stack.append((c, i))

    def pop(k: int, i: int) -> None:
        found.append((stack[k][1], i))
        while len(stack) > k:
            depth[stack.pop()[0]].pop()

    def last(openers: str) -> int | None:
        return max((depth[c][-1] for c in openers if depth.get(c)), default=None)

    for m in _QUOTE.finditer(s):
        i, c = m.start(), m[0]
        if c in "'\"":
            before, after = s[i - 1] if i else " ", s[i + 1] if i + 1 < n else " "
            opened = last(c)
            opens = (before.isspace() or before in "([{—–-„“«「（" or (c == '"' and _CJK.match(before) is not None)) and not after.isspace()
            closes = opened is not None and not (before.isspace() and not after.isspace()) and (c == '"' or not after.isalnum())
            if closes and not (opens and c == "'"):
                pop(opened, i)
            elif opens and opened is None:
                push(c, i)
            continue
        if c in "“”‘’»" and stack:
            k = last(_OPENERS.get(c, "") + ("„" if c == "”" else ""))
            if k is not None and not (c == "’" and i + 1 < n and s[i + 1].isalnum()):
                pop(k, i)
                continue
        if c in _PAIRS and c != "’":
            if c == "‘" and i and s[i - 1].isalnum():
                continue
            push(c, i)
        elif c in _CLOSERS:
            k = last(_OPENERS.get(c, ""))
            if k is not None and not (c == "’" and i + 1 < n and s[i + 1].isalnum()):
                pop(k, i)
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


class _Clauses:
    """Whether the clause that follows a quotation says who spoke; asked for rising positions, each clause is read once."""

    def __init__(self, s: str, lattices: Lattices) -> None:
        self.s, self.lattices, self.stop, self.cjk = s, lattices, -1, -1
        self.words: list[str] = []
        self.starts: list[int] = []

    def speech(self, at: int) -> bool:
        s = self.s
        if self.stop < at:
            m = _CLAUSE_END.search(s, at)
            self.stop = m.start() if m else len(s)
            found = list(_LETTERS.finditer(s, at, self.stop))
            self.words, self.starts = [m[0] for m in found], [m.start() for m in found]
        if self.cjk < at:
            m = _CJK.search(s, at)
            self.cjk = m.start() if m else len(s)
        if self.cjk < self.stop:
            return any(self.lattices.speaks(m[0]) for m in _CJK_RUN.finditer(s, at, self.stop))
        k, words = bisect_left(self.starts, at), self.words
        return k < len(words) and (any(w.lower() in SPEECH for w in words[k : k + 3]) or any(w in SPEECH for w in words[max(k, len(words) - 2) :]))


class _Evidence:
    """What speaks for a sentence end at places of a paragraph: the mark and the words around it, however far they reach."""

    def __init__(self, s: str, lattices: Lattices) -> None:
        self.s, self.lattices, self.size = s, lattices, len(s.rstrip())
        self.clauses = _Clauses(s, lattices)
        self.lead = (-1, -1)  # a stretch of blanks and marks that was passed over
        self.letters: tuple[list[int], list[int]] | None = None  # places of Greek and of other letters

    def greek(self, a: int, b: int) -> bool:
        """Whether most letters between two places are Greek."""
        if self.letters is None:
            greek = [m.start() for m in _GREEK.finditer(self.s)]
            self.letters = (greek, [m.start() for m in _OTHER.finditer(self.s)] if greek else [])
        n, others = (bisect_left(x, b) - bisect_left(x, a) for x in self.letters)
        return n > others

    def runs(self, unit: int, i: int, at: int) -> tuple[str, str]:
        """The spaceless runs that end before i and begin at a place."""
        before, after = _LAST_CJK.match(self.s, unit, i), _CJK_RUN.match(self.s, at)
        return before[0] if before else "", after[0] if after else ""

    def thai(self, a: int, b: int) -> float:
        """For the blank between two Thai characters."""
        if self.s[b] not in UNOPENED["th"]:
            return BLANK
        before, after = _LAST_THAI.match(self.s, 0, a), _THAI_RUN.match(self.s, b)
        return self.lattices.gap(before[0], after[0], BLANK, "th")

    def at(self, unit: int, i: int, j: int, end: int, quotation: bool = False) -> float:
        """Marks are s[i:j], closers reach up to ``end``; ``quotation`` if a pair ends here."""
        s = self.s
        if end >= self.size:
            return 9.0
        marks = s[i:j]
        spaced = s[end].isspace()
        if not self.lead[0] <= end <= self.lead[1]:
            self.lead = (end, _LEAD.match(s, end).end())
        first = s[self.lead[1] : self.lead[1] + 1]
        cased = first.isalpha() and first.lower() != first.upper()
        lower = cased and first == first.lower()
        here = _BLANKS.match(s, end).end()
        file_next = bool(_FILE.match(s, here)) if lower or first.isdigit() else False

        if quotation:  # that ends with a mark
            if not first or _PAUSE.match(s, end):
                return -9.0
            if lower and not file_next:
                return -9.0
            before, after = self.runs(unit, i, here)
            if before or _CJK.match(first):
                if after and self.lattices.quotes_on(after):
                    return -9.0
                return -6.0 if not spaced and (self.clauses.speech(end) or not _CJK_OPENS.match(s, end)) else 4.0
            if not cased and _AR_ON.match(s, end):
                return -6.0
            return -6.0 if self.clauses.speech(end) else 5.0
        kinds = set(marks)
        if kinds & set("。！？．｡"):
            if spaced or s[end] not in UNOPENED["ja"] | UNOPENED["zh"]:
                return FULL
            return self.lattices.gap(*self.runs(unit, i, end), FULL)
        if kinds & set("॥।؟۔።။។༎"):
            return 8.0
        if kinds & set(";;"):
            return 6.0 if not lower and self.greek(unit, i) else -9.0
        if "…" in marks or marks.startswith(".."):
            before, after = self.runs(unit, i, here)
            if before or _CJK.match(first):
                return self.lattices.gap(before, after, ELLIPSIS) if not spaced else 2.0
            if lower and not file_next:
                return -5.0
            return 4.0
        if kinds & set("!?"):
            return -4.0 if lower and not file_next else 6.0

        # A full stop.
        token = _LAST_WORD.match(s, unit, i)
        token = token[0] if token else ""
        if not spaced:
            nxt = s[end]
            if nxt in "\"'“”„«»‘’([{（「¿¡*_" and first and not lower and not s[i - 1 : i].isdigit():
                return 2.0
            if not nxt.isalpha() or (cased and lower):
                return -9.0
            ahead = _TOKEN.match(s, end)[0]
            if "://" in token or "/" in token or _PAGE.match(ahead) and rx.search(r"\d", ahead.split(".")[0]):
                return -6.0
            letters = _LAST_LETTERS.match(s, unit, i)
            if letters and len(letters[0]) < 2 and not _CJK.match(letters[0]):
                return -6.0
            if letters and letters[0].lower() in NEVER_LAST:
                return -6.0
            if "." in token and not rx.search(r"\.(?:md|txt|html?)$", token) and letters:
                return -4.0
            return 5.0
        word = token.lower()
        bare = word.strip(".")
        pair = _LAST_PAIR.match(s, unit, i)
        both = f"{pair[1]}.{pair[2]}".lower() if pair else ""
        if both in MAYBE_LAST or bare in MAYBE_LAST:
            if lower or first.isdigit():
                return -5.0
            return 3.0 if _TOKEN.match(s, here)[0].strip(".").lower() in MAYBE_LAST else 4.0
        if both in NEVER_LAST or bare in NEVER_LAST:
            known = bare in ("no", "m", "v", "p", "s", "al", "me", "str", "art", "ex", "d", "am", "st", "mar", "fr", "ed", "col", "gen", "ca", "mm", "fig", "cap", "mt", "abs", "hon", "ej", "env", "resp", "sec", "ch", "ms")
            if known and token == word and len(token) > 1 and not lower and not first.isdigit() and bare in ("no", "art", "al", "mar", "me", "am"):
                return 4.0  # a common word, not the abbreviation
            return -6.0
        if len(bare) == 1 and bare.isalpha() and not _CJK.match(bare):  # an initial, unless a sentence clearly opens after it
            opens = _NEXT_WORD.match(s, end)
            prior = _LAST_WORD.match(s, unit, i - len(token) - 1) if i - len(token) - 1 > unit else None
            return 1.5 if opens and opens[1].lower() in OPENERS and opens[1][0].isupper() and prior and prior[0].isalpha() and prior[0].islower() and token.isupper() else -5.0
        if len(bare) < 3 and bare.isdigit() and _MONTH.match(s, end):
            return -6.0  # an ordinal
        if lower and not file_next:
            return -4.0
        return 6.0


def _toggles(s: str) -> tuple[list[int], list[int]]:
    """Places after which the set of open emphasis marks changes, and that set (as bits) from there on."""
    at, masks, mask = [], [], 0
    if "*" not in s and "_" not in s:
        return at, masks
    for m in _EMPHASIS.finditer(s):
        a, b = m.span()
        before, after = s[a - 1] if a else " ", s[b] if b < len(s) else " "
        if (before.isspace() and after.isspace()) or (before.isalnum() and after.isalnum()):
            continue  # a mark of its own, or within a name
        mask ^= _STARS[m[0]]
        at.append(b)
        masks.append(mask)
    return at, masks


def _abbreviated(part: str) -> bool:
    """Whether a unit would be an abbreviation and no more."""
    part = part.strip()
    if not part.endswith(".") or " " in part:
        return False
    bare = part.strip(".").lower()
    return bare in MAYBE_LAST or bare in NEVER_LAST or len(bare) == 1


def cheapest(s: str, start: int, gaps: list[list[tuple[int, float]]], toggles: tuple[list[int], list[int]]) -> list[int]:
    """Ends of the units on the cheapest path from ``start`` to the end of s.

    ``gaps`` hold the nodes (end, evidence) between two stretches with letters or digits; a path takes one
    node of a gap or none. The cost of an edge depends on the open emphasis at both its ends, and, for an edge
    between neighbouring gaps, on its text; so for each set of open marks the best of all earlier nodes is
    enough, and the work grows with the number of nodes.
    """
    at, masks = toggles
    mask = (lambda x: masks[k - 1] if (k := bisect_right(at, x)) else 0) if at else (lambda x: 0)
    n = len(s)
    # If the path of the strongest nodes has no cost, none is better.
    ends, here, free = [], start, True
    for gap in gaps:
        end, best = gap[0]
        for e, g in gap[1:]:
            if g >= best:
                end, best = e, g
        if best > 0:
            free &= (not at or mask(end) == mask(here)) and not (end - here < 24 and _abbreviated(s[here:end]))
            ends.append(end)
            here = end
    if free and mask(here) == mask(n) and not (n - here < 24 and _abbreviated(s[here:])):
        return [*ends, n]
    open_cost = lambda a, b: OPEN_COST * (a ^ b).bit_count()
    back: dict[int, int] = {}
    far: dict[int, tuple[float, int]] = {}  # by open marks: the least cost and its last node
    near: list[tuple[float, int]] = [(0.0, start)]
    for gap in [*gaps, [(n, 0.0)]]:
        new = []
        for end, g in gap:
            m = mask(end)
            options = [(c + open_cost(k, m), x) for k, (c, x) in far.items()]
            options += [(c + open_cost(mask(x), m) + (SHORT_COST if _abbreviated(s[x:end]) else 0.0), x) for c, x in near]
            cost, back[end] = min(options)
            new.append((cost - g, end))
        for c, x in near:
            k = mask(x)
            if k not in far or (c, x) < far[k]:
                far[k] = (c, x)
        near = new
    path = [n]
    while (x := back[path[-1]]) != start:
        path.append(x)
    return path[::-1]


def split_paragraph(s: str, lattices: Lattices | None = None) -> list[tuple[int, int]]:
    """Spans of the sentences of a paragraph (line breaks count as blanks), by the cheapest path of a lattice."""
    pairs = _matched(s)
    evidence = _Evidence(s, lattices or plain_lattices())
    n = len(s)
    start = n - len(s.lstrip())
    nodes: list[tuple[int, float]] = []  # (end of a unit, evidence)
    p = 0
    at, unit, lead = 0, start, -1
    for m in _MARK.finditer(s):
        i = m.start()
        if i < at:
            continue
        while p < len(pairs) and pairs[p][1] < i:
            p += 1
        if p < len(pairs) and pairs[p][0] < i:  # within a pair: only its end can be a node
            a, b = pairs[p]
            inner = _INNER.match(s, a + 1, b)
            at = b + 1
            if not inner or (inner[0][0] in ";;"):
                continue
            if s[a] in _BRACKETS:
                lead = max(lead, _OWN.match(s, unit).end()) if lead < unit else lead
                if lead >= a:
                    nodes.append((b + 1, 7.0 if b + 1 == n or s[b + 1].isspace() else 3.0))
                    unit = b + 1
                continue
            end = b + 1
            while end < n and s[end] in _CLOSERS and s[end] not in "'\"“":
                end += 1
            if end < n and s[end] in _ENDS:
                continue
            score = evidence.at(unit, b, b + 1, end, True)
            nodes.append((end, score))
            if score > 0:
                unit = end
            continue
        # A full stop between a common word and a capital needs no closer look.
        if s[i] == "." and s[i + 1 : i + 2] == " " and s[i + 2 : i + 3].isupper():
            word = s[s.rfind(" ", unit, i) + 1 : i]
            if len(word) > 3 and word.isalpha() and word[1:].islower() and word.lower() not in NEVER_LAST and word.lower() not in MAYBE_LAST:
                nodes.append((i + 1, 6.0))
                at = unit = i + 1
                continue
        elif s[i] == "." and (s[i + 1 : i + 2].isdigit() or s[i + 1 : i + 2].islower()):
            continue  # within a number, a file name or an address
        j = i + 1
        while j < n and (s[j] in _ENDS or (s[j] == " " and s[j + 1 : j + 2] == "." and s[i] == ".")):
            j += 1
        end = j
        while end < n and s[end] in "”’»」』）)］】":
            end += 1
        # Emphasis may close here or open after it: a node on either side, the path takes the one that fits.
        close = end
        while close < n and s[close] in "*_":
            close += 1
        if close < n and s[close].isalnum():
            close = end
        at = close
        score = evidence.at(unit, i, j, end)
        nodes.append((end, score))
        if close > end:
            nodes.append((close, evidence.at(unit, i, j, close)))
        if score > 0:
            unit = end
    p = 0
    for m in _THAI_GAP.finditer(s) if not s.isascii() and _THAI_RUN.search(s) else ():
        while p < len(pairs) and pairs[p][1] < m.start():
            p += 1
        if p == len(pairs) or m.start() < pairs[p][0]:
            nodes.append((m.start(), evidence.thai(m.start(), m.end())))
    # Nodes with no letter or digit between them are one gap; what has none at the end belongs to the last unit.
    gaps: list[list[tuple[int, float]]] = []
    at = start
    nodes.sort()
    for node in nodes:
        end = node[0]
        if end >= n:
            break
        if s[at].isalnum() or (end > at + 1 and s[at + 1].isalnum()) or _WORDY.search(s, at, end):
            gaps.append([node])
        elif gaps:
            gaps[-1].append(node)
        at = end
    if gaps and not _WORDY.search(s, at):
        gaps.pop()
    ends = cheapest(s, start, gaps, _toggles(s))
    return list(zip([start, *ends], ends))


def units(text: str | None, lattices: Lattices | None = None) -> list[tuple[int, int]]:
    """Spans of all sentence units of a text; without ``lattices`` the spaceless scripts have their closed classes only."""
    found: list[tuple[int, int]] = []
    for lines, single in blocks(text or ""):
        a, b = lines[0][0], lines[-1][1]
        # Line breaks and the markers after them are blanks.
        s = text[a:b] if len(lines) == 1 else "".join(text[x:y] + " " * (z - y) for (x, y), z in zip(lines, [x for x, _ in lines[1:]] + [b]))
        s = s.replace("\t", " ").replace("\r", " ")
        for x, y in [(0, len(s))] if single else split_paragraph(s, lattices):
            part = s[x:y]
            x, y = x + len(part) - len(part.lstrip()), y - len(part) + len(part.rstrip())
            if x < y and _WORDY.search(s[x:y]):
                found.append((a + x, a + y))
    return found


def sentences(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(keys, start_pos, end_pos) of every sentence unit; whole texts, one pass, nothing shuffled.

    The words of the ``vocabulary`` file are read here and go to the executors (some thousands, a fixed file).
    """
    schema = T.StructType([docs.schema[k] for k in keys] + [T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])
    words = docs.sparkSession.sparkContext.broadcast(vocabulary_words(vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattices = Lattices(words.value)
        for pdf in batches:
            spans = [units(t, lattices) for t in pdf["__text"]]
            if not any(spans):
                continue
            out = pdf.loc[pdf.index.repeat([len(x) for x in spans]), list(keys)].reset_index(drop=True)
            flat = [x for y in spans for x in y]
            yield out.assign(start_pos=[a for a, _ in flat], end_pos=[b for _, b in flat])

    return docs.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("__text")).mapInPandas(run, schema)
