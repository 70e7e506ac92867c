"""Problem 8: text garbled by a wrong character encoding, found and restored where possible.

A garbled line is one that a chain of wrong decodings explains: encoding it by the codec it was wrongly read with and decoding it
by the right one gives its original. Every candidate original is compressed with zstandard dictionaries of its language; the
candidate with the least description length, the chain's cost included, is taken if that is shorter than the line as it is.
Otherwise the line stays unchanged.

Two passes over all texts: the first brings the lines of all distinct texts, from which words and the characters of each language are counted
and a dictionary is trained on all its clean lines; the second restores, batch by batch without a shuffle. Nothing is sampled. All lines
with characters beyond ASCII are tried. What is learnt comes from lines that no chain explains better: neither as UTF-8, nor by words less odd in themselves (symbols or capitals inside a word, scripts mixed, runs of accented
letters), nor, where that doesn't tell, by more frequent words. So it stays the same however many documents of a language are garbled.
"""

from __future__ import annotations

import codecs
import hashlib
import math
import pickle
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.plans import spread, written
from tickloom.llm.workers import kept

SAMPLE_CHARS = 8_000
#: Longer lines are learnt from in pieces of so many characters.
PIECE = 400
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
#: Bytes of the segments that a dictionary is made of.
SEGMENT = 537
#: Bytes of a language's distinct texts, at most about, on which one dictionary is trained; of so many of them one is made at a time.
PART_BYTES = 64 * 1024 * 1024
MERGED_PARTS = 64
#: Words that a task counts before it passes on what it has.
COUNTED_WORDS = 200_000
#: Languages, by number of documents, that get a dictionary; documents of others are judged by the language detected.
MOST_LANGUAGES = 256
#: A character belongs to a language if it occurs in this share of its distinct texts, in either case, in lines that no chain explains.
USUAL_SHARE = 0.08
#: Costs of a step of a chain in bytes: to UTF-8, which hardly decodes by chance, and to another codec; and of a byte lost on the way.
COST_UTF8, COST_LEGACY, COST_LOST = 1.0, 2.0, 2.0
#: Of each character foreign to the language that a candidate has beyond the number that the line has.
COST_FOREIGN = 4.0
#: Of a chain that leaves no fewer foreign characters: nothing but the description length speaks for it.
COST_UNSEEN = 8.0
#: The weight of characters foreign to a language, about that of one text in so many to the power of 2.
RAREST = -14.0
#: Characters that such a chain must change; what one or two can save is less than its cost.
LEAST_CHANGED = 3
#: A chain that explains lines of a document by so many bytes in all is then free of cost in its other lines.
PROVEN = 12.0
MOST_STEPS = 3
#: From so many lines with foreign characters on, a listed language is held against the one detected.
DOUBTFUL_LINES = 3
#: Kinds of foreign characters that must become the language's own throughout a document to prove a chain by these alone.
KINDS = 3
#: Of a line of a document that is left as it is, though a proven chain explains the others.
COST_EXCEPT = 2.0
#: Lines of which a Python worker keeps the outcome; beyond that it starts afresh, but for those of the last so many that come again.
KEPT_LINES = 100_000
#: Words with characters beyond ASCII of which a Python worker keeps what multi-byte codecs make; beyond that it starts afresh.
KEPT_WORDS = 100_000

#: Codecs with which UTF-8 is mistaken, and (wrong codec, right codec) of other mistakes.
UTF8_READ_AS = ["cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp852", "cp866", "mac_roman", "koi8-r", "iso8859-2"]
LEGACY = [
    *(("cp1252", right) for right in ("cp1250", "iso8859-2", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "cp852", "cp857", "cp866", "koi8-r", "mac_roman", "cp932", "euc_jp")),
    *(("latin-1", right) for right in ("cp1250", "cp1251", "cp1253", "cp437", "cp850", "cp852", "cp857", "mac_roman", "cp932", "euc_jp", "cp1252")),
    *(("cp1250", right) for right in ("iso8859-2", "cp852", "cp1252")),
    *(("iso8859-2", right) for right in ("cp1250", "cp1252")),
    *(("cp1251", right) for right in ("koi8-r", "cp866", "iso8859-5", "cp1252", "cp1250")),
    ("koi8-r", "cp1251"),
    ("cp866", "cp1251"),
    *(("cp1253", right) for right in ("cp737", "cp1252")),
    *(("mac_roman", right) for right in ("cp1252", "cp932", "euc_jp")),
    *(("cp437", right) for right in ("cp1252", "cp1250")),
    *(("cp850", right) for right in ("cp1252", "cp1250")),
]
#: Right codecs of scripts that the list above doesn't cover; tried only where a language of the corpus is written in them.
OTHER_SCRIPTS = ["cp1255", "cp1256", "cp874", "gbk", "big5", "euc_kr"]
CHAINS = [*((wrong, "utf-8") for wrong in UTF8_READ_AS), *LEGACY, *((wrong, right) for right in OTHER_SCRIPTS for wrong in ("cp1252", "latin-1"))]
#: UTF-8 of characters that are up to so many times rarer than the rarest read is taken for read with another codec in what is learnt.
UTF8_RARITY = 10
_SYMBOLS = frozenset(("Sm", "Sc", "Sk", "So", "No", "Cc", "Co", "Cn", "Po"))
LOST = "�"
_MULTI = {"utf-8", "cp932", "euc_jp", "gbk", "big5", "euc_kr"}
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
_HIGH = re.compile(r"[^\x00-\x7f]")
_HIGHS = re.compile(r"[^\x00-\x7f]+")
#: Words; bytes of a garbled one can look like other blanks, as 0xA0 does.
_TOKENS = re.compile(r"([ \t\n\r\f\v]+)")
_OTHER_BLANKS = re.compile(r"[\t\n\r\f\v]")
_LINE_ENDS = re.compile(r"(\r\n|\n|\r)")
_LOWER, _UPPER = ("".join(c for c in map(chr, range(0x250, 0x10000)) if kind(c)) for kind in (str.islower, str.isupper))
#: Small letter before a capital, in scripts in which codecs differ by case: no word is written so.
_MIXED = re.compile(f"[{_LOWER}][{_UPPER}]")


def _encoding_map(codec: str) -> object:
    """A charmap of a one-byte codec in which undefined bytes stand for the control character of their number."""
    table = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256))
    return codecs.charmap_build(table)


def _script(c: str) -> str:
    """The script of a letter, by the first word of its name; those of Japanese and Chinese are one."""
    word = unicodedata.name(c, "?").split(" ", 1)[0].split("-", 1)[0]
    return "CJK" if word in ("HIRAGANA", "KATAKANA", "HALFWIDTH") else word


@dataclass
class Model:
    """Per language, the largest first: its characters beyond ASCII, a trained zstandard dictionary and how usual the characters are."""

    usual: dict[str, str]
    dictionaries: dict[str, bytes]
    #: Of the characters of ``usual`` in order, the binary logarithm of the share of texts that have them.
    weights: dict[str, list[float]] = field(default_factory=dict)

    def scripts(self) -> dict[str, str]:
        """Of each language the script, not Latin, in which most of its letters beyond ASCII are; none for the others."""
        out = {}
        for k, letters in self.usual.items():
            kinds = Counter(_script(c) for c in letters if c.isalpha())
            name, n = kinds.most_common(1)[0] if kinds else ("", 0)
            if name not in ("", "LATIN") and 2 * n > kinds.total():
                out[k] = name
        return out

    def rights(self) -> dict[str, list[str]]:
        """Wrong codec to right codecs, those of other scripts only if a language's letters are mostly in them."""
        def needed(right: str) -> bool:
            for letters in self.usual.values():
                own = [c for c in letters if c.isalpha()]
                if own and sum(len(c.encode(right, "ignore")) > 0 for c in own) * 2 > len(own) and not any(len(c.encode("cp1252", "ignore")) for c in own):
                    return True
            return False

        wanted = {right: right not in OTHER_SCRIPTS or needed(right) for _, right in CHAINS}
        out: dict[str, list[str]] = {}
        for wrong, right in CHAINS:
            if wanted[right]:
                out.setdefault(wrong, []).append(right)
        return out


def _image(wrong: str, right: str) -> dict[str, str]:
    """The original of each character of a codec's upper half, if that is a text's."""
    out = {}
    for b in range(128, 256):
        made = bytes([b]).decode(right, "ignore")
        if made and unicodedata.category(made) not in _NO_TEXT:
            out[bytes([b]).decode(wrong, "ignore") or chr(b)] = made
    return out


def _class(codec: str, first: int, last: int) -> str:
    """The characters of a range of bytes, for a class of a regular expression."""
    return "".join(re.escape(bytes([b]).decode(codec, "ignore") or chr(b)) for b in range(first, last + 1))


def _holds_utf8(text: str) -> bool:
    """Whether a character that begins one in UTF-8 and one that goes on with it, by one of the codecs, stand side by side; any UTF-8
    read with another codec has such a pair."""
    coarse, exact = kept("utf-8 pairs", _pair_patterns)
    return coarse.search(text) is not None and exact.search(text) is not None


def _pair_patterns() -> tuple[re.Pattern, re.Pattern]:
    """Of any two codecs' characters, which is quickly told, and of one codec's."""
    pairs = [(_class(w, 0xC2, 0xF4), _class(w, 0x80, 0xBF)) for w in UTF8_READ_AS]
    return re.compile(f"[{''.join(a for a, _ in pairs)}][{''.join(b for _, b in pairs)}]"), re.compile("|".join(f"[{a}][{b}]" for a, b in pairs))


@dataclass(slots=True)
class _Word:
    text: str
    #: Its characters beyond ASCII, and the codecs that have them all, as bits.
    chars: str
    codecs: int
    #: What UTF-8 and what double-byte codecs make of it, when asked for.
    utf8: tuple | None = None
    double: tuple | None = None


def _maps() -> dict[str, object]:
    """The wrong codecs' charmaps, which can't be sent to workers."""
    return kept("charmaps", lambda: {w: _encoding_map(w) for w, _ in CHAINS})


class Restorer:
    def __init__(self, model: Model):
        self.usual = {k: frozenset(v) for k, v in model.usual.items()}
        self.weights = {k: dict(zip(model.usual[k], w, strict=True)) for k, w in model.weights.items()}
        self.press = {}
        for lang, content in model.dictionaries.items():
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            self.press[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.floor = min(len(p.compress(b"")) for p in (self.plain, *self.press.values()))
        self.maps, self.rights = _maps(), model.rights()
        self.scripts, self.by_script = model.scripts(), {}
        for k, name in self.scripts.items():
            if k in self.press:
                self.by_script.setdefault(name, k)
        self.cased = frozenset(k for k, v in model.usual.items() if k in self.scripts and any(c in _CASED for c in v))
        self.script_of: dict[str, str] = {}
        self.has = {w: frozenset(c for b in range(128, 256) for c in (bytes([b]).decode(w, "ignore") or chr(b))) for w in self.rights}
        self.bits = [(1 << i, w) for i, w in enumerate(self.rights)]
        self.multi = {w: [x for x in rights if x in _MULTI] for w, rights in self.rights.items()}
        #: The chains to UTF-8 and to double-byte codecs, and the place of each among its like.
        self.to_multi = [[(bit, w, r) for bit, w in self.bits for r in self.multi[w] if (r == "utf-8") == utf8] for utf8 in (True, False)]
        self.places = {(w, r): i for chains in self.to_multi for i, (_, w, r) in enumerate(chains)}
        self.words: dict[str, _Word] = {}
        self.codecs: dict[int, list] = {}
        #: Of each character the codecs that have it, as bits.
        self.masks: dict[str, int] = {}
        for bit, w in self.bits:
            for c in self.has[w]:
                self.masks[c] = self.masks.get(c, 0) | bit
        self.images = {(w, r): _image(w, r) for w, rights in self.rights.items() for r in rights if r not in _MULTI}
        #: Of each original the characters that it is read as, with the wrong codecs as bits.
        self.origins: dict[str, dict[str, int]] = {}
        for bit, w in self.bits:
            for c, d in (x for r in self.rights[w] if (w, r) in self.images for x in self.images[w, r].items()):
                self.origins.setdefault(d, {})[c] = self.origins.get(d, {}).get(c, 0) | bit
        self.ascii_origins = _ASCII.intersection(self.origins)
        #: Of each chain to a one-byte codec its characters' originals, all those characters, and those that stay.
        self.one_byte = {k: (image, str.maketrans(image), frozenset(image), frozenset(c for c, d in image.items() if c == d)) for k, image in self.images.items()}
        self.tables: dict[tuple, list] = {}
        self.merged: dict[tuple, dict] = {}
        self.rising: dict[tuple, dict] = {}
        self.gains: dict[tuple, dict] = {}
        self.joined: dict[tuple, frozenset] = {}
        #: By languages the characters met so far that are of no other language's script.
        self.harmless: dict[tuple, set] = {}
        #: The outcome of lines by languages, how many there are, and the same of those before them.
        self.lines: dict[tuple, dict[str, tuple]] = {}
        self.kept_lines = 0
        self.older: dict[tuple, dict[str, tuple]] = {}

    def length(self, text: str, langs: tuple[str, ...]) -> int:
        """Description length in bytes: the least over the languages' dictionaries, in the text's own or in lower case."""
        raw, low = text.encode("utf-8", "surrogatepass"), text.lower()
        presses = [self.press.get(k, self.plain) for k in langs or ("",)]
        least = min([len(p.compress(raw)) for p in presses])
        # The letters among the first characters mostly are too many already.
        if text != low and (twice := 2 * sum(map(str.isupper, text))) > sum(map(str.isalpha, text[: 2 * twice + 8])) and twice > sum(map(str.isalpha, text)):
            raw = low.encode("utf-8", "surrogatepass")
            least = min(least, *[len(p.compress(raw)) for p in presses])
        return least

    def allowed(self, langs: tuple[str, ...]) -> frozenset:
        """Characters beyond ASCII of the languages, and those that say nothing."""
        if langs not in self.joined:
            self.joined[langs] = _NEUTRAL.union(*(self.usual.get(k, ()) for k in langs))
        return self.joined[langs]

    def odd(self, text: str, langs: tuple[str, ...]) -> set[str]:
        """Characters beyond ASCII that are not the languages'."""
        return set("".join(_HIGHS.findall(text))) - self.allowed(langs)

    def odd_count(self, text: str, langs: tuple[str, ...], here: str | None = None) -> int:
        """The number of such characters, and of capitals after small letters; ``here`` has all beyond ASCII, if known."""
        here = "".join(_HIGHS.findall(text)) if here is None else here
        allowed, kinds = self.allowed(langs), frozenset(here)
        odd = 0 if kinds <= allowed else sum([c not in allowed for c in here])
        return odd + len(_MIXED.findall(text)) if kinds and max(kinds) >= "\u0250" else odd

    def _decoded(self, raw: bytes, right: str, high: int) -> tuple[str, int] | None:
        """The text and the number of bytes lost, or None."""
        try:
            return raw.decode(right), 0
        except UnicodeDecodeError:
            if right not in _MULTI:
                return None
        out = raw.decode(right, "replace")
        lost = out.count(LOST)
        return (out, lost) if lost * 4 <= high else None

    def _encoded(self, text: str, wrong: str) -> bytes | None:
        return _encoded(text, self.maps[wrong])

    def _usualness(self, langs: tuple[str, ...]) -> dict[str, float]:
        """The weights of the languages' characters, each by the language in which it is most usual."""
        if langs not in self.merged:
            made: dict[str, float] = {}
            for k in langs:
                for c, x in self.weights.get(k, {}).items():
                    made[c] = max(x, made.get(c, RAREST))
            self.merged[langs] = made
        return self.merged[langs]

    def _risers(self, langs: tuple[str, ...]) -> dict[str, int]:
        """The characters that a chain turns into more usual ones, each with the wrong codecs of such chains as bits."""
        if langs not in self.rising:
            usual, out = self._usualness(langs), {}
            for d in self.ascii_origins.union(usual):
                made = usual.get(d, RAREST if d > "\x7f" else 0.0)
                for c, bits in self.origins.get(d, {}).items():
                    if made > usual.get(c, RAREST):
                        out[c] = out.get(c, 0) | bits
            self.rising[langs] = out
        return self.rising[langs]

    def _rises(self, chain: tuple[str, str], langs: tuple[str, ...]) -> dict[str, float]:
        """By how much each character becomes more usual."""
        if (chain, langs) not in self.gains:
            usual = self._usualness(langs)
            self.gains[chain, langs] = {c: usual.get(d, RAREST) - usual.get(c, RAREST) if c != d else 0.0 for c, d in self.images[chain].items()}
        return self.gains[chain, langs]

    def _word(self, x: str) -> _Word:
        """A word with characters beyond ASCII, these, and the codecs that have them all, as bits."""
        if x not in self.words:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            chars, own = "".join(_HIGHS.findall(x)), -1
            for c in set(chars):
                own &= self.masks.get(c, 0)
            if len(x) > PIECE:
                return _Word(x, chars, own)
            self.words[x] = _Word(x, chars, own)
        return self.words[x]

    def _multi_of(self, word: _Word, double: bool) -> tuple[bytes, dict[int, tuple[str, int]]]:
        """Of each chain to UTF-8, or to a double-byte codec, the bytes that the word loses by it wherever it stands, at least and 255 at
        most; and what it makes of the word if it explains it."""
        if (made := word.double if double else word.utf8) is None:
            n, lost, out = len(word.chars), [], {}
            if double or _holds_utf8(word.text):
                for i, (bit, wrong, right) in enumerate(self.to_multi[double]):
                    few = 0
                    if word.codecs & bit and (raw := self._encoded(word.text, wrong)):
                        try:
                            done = raw.decode(right)
                        except UnicodeDecodeError:
                            done = raw.decode(right, "replace")
                            few = min(done.count(LOST), (raw + b" ").decode(right, "replace").count(LOST))
                        if n > 1 and done != word.text and (gone := done.count(LOST) if few else 0) * 4 <= n:
                            out[i] = done, gone
                        few = min(few, 255) if right != "euc_kr" else 0  # in which an end can take back what stands before it
                    lost.append(few)
                made = bytes(lost), out or _NOTHING
            else:  # all are lost of a word without a pair
                made = bytes([min(n, 255)]) * len(self.to_multi[double]), _NOTHING
            if double:
                word.double = made
            else:
                word.utf8 = made
        return made

    def _codecs(self, bits: int) -> list[tuple[int, str]]:
        if bits not in self.codecs:
            self.codecs[bits] = [(bit, w) for bit, w in self.bits if bits & bit]
        return self.codecs[bits]

    def _verdicts(self, wrong: str, langs: tuple[str, ...]) -> list[tuple[tuple[str, str], dict, dict, frozenset, frozenset, frozenset]]:
        """For each chain from ``wrong`` to a one-byte codec the originals of its characters, also as a table, the characters that have
        one, those that stay, and those whose originals are foreign to the languages."""
        if (wrong, langs) not in self.tables:
            allowed = self.allowed(langs)
            chains = [((wrong, r), *self.one_byte[wrong, r]) for r in self.rights[wrong] if (wrong, r) in self.one_byte]
            self.tables[wrong, langs] = [(*x, frozenset([c for c, d in x[1].items() if d > "\x7f" and d not in allowed])) for x in chains]
        return self.tables[wrong, langs]

    def candidates(self, text: str, only: frozenset | None = None) -> Iterator[tuple[str, int, tuple[str, str]]]:
        """(candidate, bytes lost, chain) by the whole line, then by those of its words that the wrong codec has if it lacks a character;
        of all chains or ``only`` those given."""
        found = _HIGH.findall(text)
        high, kinds, partly = len(found), frozenset(found), []
        rights_of = self.rights
        if only is not None:
            rights_of = {}
            for wrong, right in sorted(only):
                rights_of.setdefault(wrong, []).append(right)
        for wrong, rights in rights_of.items():
            if not kinds <= self.has[wrong]:
                if not kinds.isdisjoint(self.has[wrong]):
                    partly.append(wrong)
                continue
            raw = self._encoded(text, wrong)
            for right in rights if raw is not None else ():
                done = self._decoded(raw, right, high)
                if done and done[0] != text:
                    yield *done, (wrong, right)
        parts = [(x, len(_HIGH.findall(x))) for x in _TOKENS.split(text)] if partly else []
        for wrong in partly:
            raws = [self._encoded(x, wrong) if n else None for x, n in parts]
            for right in rights_of[wrong] if any(raws) else ():
                if done := self._by_words(parts, raws, right):
                    yield *done, (wrong, right)

    def _cheaper(self, text: str, here: str, kinds: frozenset, langs: tuple[str, ...], odd: int, mixed: bool, paired: bool, limit: list[float]) -> Iterator[tuple[str, int, tuple[str, str]]]:
        """The candidates of a line but for those whose costs alone are no less than ``limit``, which may fall meanwhile.

        What one-byte codecs make of a line is known from its characters: how many become foreign is counted before a text is made. A chain
        that leaves no fewer must change ``LEAST_CHANGED``, to characters that are more usual on the whole."""
        high = len(here)
        allowed = self.allowed(langs)
        # Letters of another script are at most all that are beyond ASCII: its language counts only where these are many.
        judges = langs if 3 * high <= len(text) else (*langs, *self.by_script.values())
        # Double-byte text of mostly Latin letters isn't in a language of that script: two bytes, of which one may be ASCII, make one
        # character that is foreign.
        foreign = (high + 1) // 2 - odd if 5 * high <= len(text) else -1
        unseen = COST_LEGACY + COST_UNSEEN
        doubtful = -1e9 if foreign < 0 else unseen + COST_FOREIGN * foreign if odd and high >= LEAST_CHANGED else 1e9

        def hopeful(chars: str, gone: int, wrong: str) -> Iterator[tuple[tuple[str, str], dict]]:
            """Chains and tables that may explain the characters, of which ``gone`` are foreign as they are."""
            n = len(chars)
            if not gone and not mixed and (n < LEAST_CHANGED or unseen >= limit[0]):
                return
            own = frozenset(chars)
            for chain, _, table, origins, staying, strange in self._verdicts(wrong, judges):
                if not own <= origins:
                    continue
                # As many at least become foreign as there are kinds of them.
                foreign = own & strange
                if not mixed and (more := len(foreign) - gone) >= 0 and unseen + COST_FOREIGN * more >= limit[0]:
                    continue
                if own <= staying:
                    continue
                if not mixed:
                    more = sum(map(chars.count, foreign)) - gone
                    if (COST_LEGACY if more < 0 else unseen + COST_FOREIGN * more) >= limit[0]:
                        continue
                    if more >= 0 and n - sum(map(chars.count, own & staying)) < LEAST_CHANGED and 1e9 >= limit[0]:
                        continue
                    if more >= 0 and self.weights and sum(map(self._rises(chain, judges).__getitem__, chars)) <= 0:
                        continue
                yield chain, table

        gone = odd if not mixed else sum([c not in allowed for c in here])
        words = []
        hope = -1  # the codecs, as bits, that may explain characters none of which is foreign
        if not odd and not mixed and self.weights:
            hope, rising = 0, self._risers(judges)
            for x in kinds:
                hope |= rising.get(x, 0)
            if not hope and not paired and doubtful >= limit[0]:
                return
        if not (paired or odd or mixed or doubtful < limit[0]) and (not hope or high < LEAST_CHANGED or unseen >= limit[0]):
            return
        whole, some = -1, 0
        for x in _high_words(text):
            word = self._word(x)
            words.append(word)
            whole &= word.codecs
            some |= word.codecs

        def bearable(wrong: str, right: str) -> bool:
            """Whether the words lose few enough bytes for the whole line to be explained."""
            lost, double, place = 0, right != "utf-8", self.places[wrong, right]
            for w in words:
                lost += ((w.double if double else w.utf8) or self._multi_of(w, double))[0][place]
                if lost * 4 > high:
                    return False
            return True

        for bit, wrong in self._codecs(whole):
            for right in self.multi[wrong]:
                if (paired if right == "utf-8" else doubtful < limit[0]) and bearable(wrong, right):
                    raw = self._encoded(text, wrong)
                    done = self._decoded(raw, right, high) if raw else None
                    if done and done[0] != text:
                        yield *done, (wrong, right)
            for chain, table in hopeful(here, gone, wrong) if hope & bit else ():
                yield text.translate(table), 0, chain
        # Of the chains to UTF-8 and to double-byte codecs those that explain a word, by their places.
        known: list[set | None] = [None, None]
        for bit, wrong in self._codecs(some & ~whole):
            if not (hope & bit or paired or doubtful < limit[0]):
                continue
            inside = "".join([w.chars for w in words if w.codecs & bit])
            lost = sum([c not in allowed for c in inside]) if gone else 0
            if lost or mixed or hope & bit and len(inside) >= LEAST_CHANGED:
                own = {w.text for w in words if w.codecs & bit}
                for chain, table in hopeful(inside, lost, wrong):
                    yield "".join([x.translate(table) if x in own else x for x in _TOKENS.split(text)]), 0, chain
            for right in self.multi[wrong]:
                if paired if right == "utf-8" else doubtful < limit[0]:
                    double, place = right != "utf-8", self.places[wrong, right]
                    if known[double] is None:
                        known[double] = set().union(*[self._multi_of(w, double)[1] for w in words])
                    if place in known[double]:
                        made = {w.text: self._multi_of(w, double)[1].get(place) for w in words}
                        tokens = [(x, made.get(x)) for x in _TOKENS.split(text)]
                        yield "".join([y[0] if y else x for x, y in tokens]), sum([y[1] for _, y in tokens if y]), (wrong, right)

    def _by_words(self, parts: list[tuple[str, int]], raws: list[bytes | None], right: str) -> tuple[str, int] | None:
        """Words with their numbers of characters beyond ASCII, and their bytes if the wrong codec has them."""
        out, lost, changed = [], 0, False
        for (x, high), raw in zip(parts, raws, strict=True):
            done = self._decoded(raw, right, high) if raw and (high > 1 or right not in _MULTI) else None
            out.append(done[0] if done else x)
            if done and done[0] != x:
                lost, changed = lost + done[1], True
        return ("".join(out), lost) if changed else None

    def best(self, text: str, langs: tuple[str, ...], free: frozenset) -> tuple[str, tuple[tuple[str, str], ...], float]:
        """(text or its best original, the chain's steps, bytes saved).

        A candidate must have no unassigned or private characters; if it leaves no fewer that are foreign to the document's
        languages, or to the language of its script, its length must be the less. Signs that stand alone and would become
        letters count as foreign; UTF-8 of the language's own characters needs no fewer."""
        steps, saved = [], 0.0
        for _ in range(MOST_STEPS):
            if text.isascii():
                break
            runs, allowed = _HIGHS.findall(text), self.allowed(langs)
            here = "".join(runs)
            kinds, choice, seen, lone = frozenset(here), None, set(), None
            odd = 0 if kinds <= allowed else sum([c not in allowed for c in here])
            mixed = len(_MIXED.findall(text)) if max(kinds) >= "\u0250" else 0
            odd, paired = odd + mixed, len(runs) < len(here) and _holds_utf8(text)
            if odd == 0 and not free and len(here) < LEAST_CHANGED and not paired:
                break  # nothing but UTF-8 could explain so few characters, all the language's own
            if odd == 0 and not free and not paired and self.weights and 5 * len(here) <= len(text):
                # Few characters among Latin ones: as double-byte text all would be foreign, and no other codec makes them more usual.
                if self._risers(langs).keys().isdisjoint(kinds):
                    break
            size_now = len(text.encode("utf-8", "surrogatepass"))
            # Most lines of the language's own characters have no candidate even if they couldn't be compressed at all; zstandard makes none longer but by its headers.
            if not free and not odd and next(self._cheaper(text, here, kinds, langs, odd, mixed > 0, paired, [size_now + size_now // 1000 + 20.0]), None) is None:
                break
            least = now = float(self.length(text, self._langs(text, langs, here)))
            limit = [least - self.floor]
            # What other lines prove is all that is tried once something is proven.
            for done, lost, chain in self.candidates(text, free) if free else self._cheaper(text, here, kinds, langs, odd, mixed > 0, paired, limit):
                if done in seen and chain not in free:
                    continue
                seen.add(done)
                made = "".join(_HIGHS.findall(done))
                own = self._langs(done, langs, made)
                more = self.odd_count(done, own, made) - odd
                if lone is None:
                    lone = {i for i, x in enumerate(_TOKENS.split(text)) if not x.isascii() and not any(map(str.isalnum, x))}
                if lone:
                    more += sum(any(map(str.isalnum, x)) for i, x in enumerate(_TOKENS.split(done)) if i in lone)
                if more == 0 and chain[1] == "utf-8" and not lost and self._own_letters(done, text, own):
                    more = -1
                foreign = COST_UNSEEN + COST_FOREIGN * more if more >= 0 else 0.0
                cost = (-1.0 if more < 0 and _oddness_of(done) <= _oddness_of(text) else 0.0) if chain in free else COST_UTF8 if chain[1] == "utf-8" else COST_LEGACY
                cost += foreign + lost * COST_LOST + _controls(done)
                if cost + self.floor >= least or not _NO_TEXT.isdisjoint(map(unicodedata.category, set(made))):
                    continue
                size = self.length(done, own) + cost
                if chain[1] != "utf-8":  # that its characters take fewer bytes speaks for no candidate of another codec
                    size += max(0, size_now - len(done.encode("utf-8", "surrogatepass")))
                if size < least:
                    least, choice = size, (done, chain)
                    limit[0] = least - self.floor
            if choice is None:
                break
            text = choice[0]
            steps.append(choice[1])
            saved += now - least
        return text, tuple(steps), saved

    def _by_kinds(self, lines: list[str], left: list[int], langs: tuple[str, ...]) -> dict[tuple, float]:
        """Bytes for each chain that turns ``KINDS`` or more kinds of foreign characters of odd words into the languages' own in less odd ones."""
        gains, kinds = Counter(), {}
        for i in left if len(set().union(*(self.odd(lines[i], langs) for i in left))) >= KINDS else ():
            odd, count, strange = self.odd(lines[i], langs), self.odd_count(lines[i], langs), _oddness_of(lines[i])
            for done, lost, chain in self.candidates(lines[i]) if odd and strange else ():
                fewer = count - self.odd_count(done, langs)
                if fewer > 0 and not lost and not _controls(done) and _oddness_of(done) < strange:
                    gains[chain] += COST_FOREIGN * fewer
                    kinds.setdefault(chain, set()).update(odd - self.odd(done, langs))
        return {chain: gain for chain, gain in gains.items() if len(kinds[chain]) >= KINDS}

    def _own_letters(self, done: str, text: str, langs: tuple[str, ...]) -> bool:
        """Whether all characters beyond ASCII that ``text`` lacks are the languages' own."""
        new = set(_HIGH.findall(done)).difference(text)
        return bool(new) and new <= frozenset().union(*(self.usual.get(k, ()) for k in langs))

    def _rest(self, lines: list[str], left: list[int], langs: tuple[str, ...], free: frozenset) -> dict[int, str]:
        """Originals of the lines that are left, by a chain that other lines of the document prove: of all of them if that is shorter
        than to name the exceptions, else of those that are shorter each on its own."""
        options: dict[tuple, dict[int, tuple[str, float]]] = {}
        for i in left:
            odd, size = self.odd_count(lines[i], langs), float(self.length(lines[i], langs))
            for done, lost, chain in self.candidates(lines[i], free):
                if not lost and self.odd_count(done, self._langs(done, langs)) <= odd:
                    gain = size - self.length(done, self._langs(done, langs)) - _controls(done)
                    if i not in options.setdefault(chain, {}) or options[chain][i][1] < gain:
                        options[chain][i] = done, gain
        out: dict[int, tuple[str, float]] = {}
        for chain, found in options.items():
            whole = len(free) == 1 and sum(gain + COST_EXCEPT for _, gain in found.values()) > 0
            for i, (done, gain) in found.items():
                if (whole or gain > COST_LEGACY) and (i not in out or out[i][1] < gain):
                    out[i] = done, gain
        return {i: done for i, (done, _) in out.items()}

    def _langs(self, text: str, langs: tuple[str, ...], here: str | None = None) -> tuple[str, ...]:
        """With the language of a script that most of the letters have; ``here`` has all characters beyond ASCII, if known."""
        here = "".join(_HIGHS.findall(text)) if here is None else here
        if not self.by_script or not _BEYOND_LATIN.search(here):
            return langs
        if (harmless := self.harmless.get(langs)) is None:
            harmless = self.harmless[langs] = set()
        if harmless.issuperset(here):
            return langs
        kinds: dict[str, int] = {}
        for c in set(here):
            if c not in self.script_of:
                self.script_of[c] = _script(c) if c.isalpha() else ""
            kinds[self.script_of[c]] = kinds.get(self.script_of[c], 0) + here.count(c)
            if (k := self.by_script.get(self.script_of[c])) is None or k in langs:
                harmless.add(c)
        for name, k in self.by_script.items():
            if name in kinds and k not in langs and kinds[name] * 2 > sum(map(str.isalpha, text)):
                return (*langs, k)
        return langs

    def detect(self, text: str) -> str:
        raw = text.encode("utf-8", "surrogatepass")
        return min(self.press, key=lambda k: len(self.press[k].compress(raw)), default="")

    def _kept_best(self, line: str, langs: tuple[str, ...]) -> tuple[str, tuple[tuple[str, str], ...], float]:
        """The outcome of a line that isn't among the last ones."""
        if self.kept_lines >= KEPT_LINES:
            self.older, self.lines, self.kept_lines = self.lines, {}, 0
        done = self.older.get(langs, _NOTHING).get(line) or self.best(line, langs, _NONE)
        self.lines.setdefault(langs, {})[line] = done
        self.kept_lines += 1 + len(line) // PIECE  # a long one counts as several
        return done

    def restore(self, text: str, lang: str | None) -> tuple[str, list[str], int]:
        """(restored text, chains used, number of lines garbled). Line ends stay as they are."""
        lang = _clean(lang)
        langs = (lang,) if lang in self.press else ()
        if text.isascii():
            return text, [], 0
        odd, mixed = self.odd(text, langs), lang in self.cased and _MIXED.search(text) is not None
        ends = "\r" in text
        lines = _LINE_ENDS.split(text) if ends else text.split("\n")
        high = [i for i, x in enumerate(lines) if not x.isascii()]
        suspects = lambda: [i for i in high if not odd.isdisjoint(lines[i]) or mixed and _MIXED.search(lines[i])] if odd or mixed else []
        chosen = suspects()
        if not langs or len(chosen) >= DOUBTFUL_LINES:
            found = self.detect(text)
            if found and found not in langs:
                other = self.odd(text, (found,))
                if not langs or len(other) < len(odd):
                    odd = other
                langs = (*langs, found)
                chosen = suspects()
        if not langs:
            langs = ("",)
        results, gains = {}, Counter()
        known = self.lines.setdefault(langs, {})
        for i in high:
            line = lines[i]
            results[i] = done = known.get(line) or self._kept_best(line, langs)
            for chain in done[1]:
                gains[chain] += done[2]
        for chain, gain in self._by_kinds(lines, [i for i in chosen if i in results and not results[i][1]], langs).items():
            gains[chain] += gain
        if not gains:
            return text, [], sum(LOST in lines[i] for i in high) if LOST in text else 0
        free = frozenset(chain for chain, gain in gains.items() if gain >= PROVEN)
        garbled, chains, done_lines = 0, Counter(), set()
        for i in results:
            done, steps, _ = results[i]
            if not steps and free and i in chosen:
                done, steps, _ = self.best(lines[i], langs, free)
                steps = steps if set(steps) <= free else ()
            if steps:
                lines[i] = done
                done_lines.add(i)
                chains[" ".join(f"{right}<{wrong}" for wrong, right in steps)] += 1
            if steps or LOST in lines[i]:
                garbled += 1
        if free:
            left = [i for i in results if not results[i][1] and lines[i].isascii() is False and i not in done_lines]
            for i, done in self._rest(lines, left, langs, free).items():
                lines[i], garbled = done, garbled + 1
        return ("" if ends else "\n").join(lines), sorted(chains), garbled


#: Letters of the scripts in ``_MIXED``.
_CASED = frozenset(_LOWER + _UPPER)
#: Blocks of letters other than Latin.
_BEYOND_LATIN = re.compile("[\u0370-\u1dff\u1f00-\u1fff\u2c00-\u2dff\u2e80-\uffff\U00010000-\U0010ffff]")
_NO_TEXT = frozenset(("Cn", "Co", "Cs"))
_NONE: frozenset = frozenset()
_NOTHING: dict = {}
#: Byte order mark, blanks, format characters and combining marks, in which no language differs.
_NEUTRAL = frozenset(c for c in map(chr, range(128, 0x10000)) if unicodedata.combining(c) or unicodedata.category(c) == "Cf" and c != "\xad")


def _controls(text: str) -> int:
    """Extra cost of control characters, which no original has."""
    return 4 * len(_CONTROL.findall(text))


def _clean(lang: str) -> str:
    return (lang or "").strip().lower()


_RUNS = re.compile(r"[^\x00-\x7f]{2,}")
_ASCII = frozenset(map(chr, range(128)))
_PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def _read_wrong(run: str) -> bool:
    """Whether characters beyond ASCII are UTF-8 read with another codec."""
    known = kept("runs", dict)
    if run not in known:
        if len(known) >= KEPT_LINES:
            known.clear()
        known[run] = _holds_utf8(run) and any(_is_utf8(run, charmap) for charmap in (_maps()[w] for w in UTF8_READ_AS))
    return known[run]


def _is_utf8(run: str, charmap: object) -> bool:
    try:
        codecs.charmap_encode(run, "strict", charmap)[0].decode()
    except UnicodeError:
        return False
    return True


def _oddness(word: str) -> int:
    """How odd a word is in itself, in any language: symbols and controls beside letters, capitals after small letters beyond ASCII,
    scripts mixed, four accented letters in a row."""
    n, run, last, script = 0, 0, " ", ""
    for i, c in enumerate(word):
        high = c > "\x7f"
        if c.isalpha():
            now = _script(c) if high else "LATIN"
            n += script not in ("", now)
            n += last.islower() and c.isupper() and (high or last > "\x7f")
            run = run + 1 if high and now == "LATIN" else 0
            n += run == 4
            script = now
        else:
            run = 0
            if high and unicodedata.category(c) in _SYMBOLS:
                after = i + 1 < len(word) and word[i + 1].isalpha()
                n += "\x80" <= c <= "\x9f" or after or last.isalpha() and c not in "™®°²"
            elif c == "\xad":  # a soft hyphen stands between letters
                n += not last.isalpha()
        last = c
    return n


def _oddness_of(line: str) -> int:
    return sum(_oddness(x) for x in _TOKENS.split(line) if not x.isascii())


def _high_words(line: str) -> list[str]:
    """Words with characters beyond ASCII; none holds a blank or a line end."""
    return [x for x in (_TOKENS.split(line) if _OTHER_BLANKS.search(line) else line.split(" ")) if not x.isascii()]


def _words(line: str) -> list[str]:
    """The same without punctuation around them."""
    return [x.strip(_PUNCTUATION) for x in _high_words(line)]


def _letter_counts(words: Iterator[tuple[str, int]]) -> Counter:
    """How often words with each character beyond ASCII occur."""
    letters: Counter = Counter()
    for w, n in words:
        for c in set(_HIGH.findall(w)):
            letters[c] += n
    return letters


def _one_byte_tables() -> list[tuple[dict[str, str], dict[int, str]]]:
    """Of each chain to a one-byte codec the originals of the wrong codec's characters, and the same for ``str.translate``."""
    out = []
    for wrong, right in CHAINS:
        if right not in _MULTI:
            image = {}
            for b in range(128, 256):
                if made := bytes([b]).decode(right, "ignore"):
                    image[bytes([b]).decode(wrong, "ignore") or chr(b)] = made
            out.append((image, str.maketrans(image)))
    return out


class Readings:
    """What chains make of the words of a language, of which the characters' counts are known."""

    def __init__(self, letters: dict[str, int]):
        self.letters = letters
        #: Of each character the chains to one-byte codecs, as bits, by which it becomes a character of the language, and another one.
        self.into: dict[str, int] = {}
        self.other: dict[str, int] = {}
        self.tables = kept("one-byte tables", _one_byte_tables)
        for i, (image, _) in enumerate(self.tables):
            for c, d in image.items():
                if d <= "\x7f" or d in letters:
                    self.into[c] = self.into.get(c, 0) | 1 << i
                    if c != d:
                        self.other[c] = self.other.get(c, 0) | 1 << i
        self.multi = [(w, r) for w, r in CHAINS if r in _MULTI and r != "utf-8"]

    def utf8(self, word: str) -> bool:
        """Whether a word is UTF-8, read with another codec, of characters that are no rarity beside its own."""
        if not _holds_utf8(word):
            return False
        rarest = min(self.letters.get(c, 0) for c in _HIGH.findall(word))
        for wrong in UTF8_READ_AS:
            try:
                done = (_encoded(word, _maps()[wrong]) or b"").decode()
            except UnicodeError:
                continue
            if done and all(self.letters.get(c, 0) * UTF8_RARITY > rarest for c in _HIGH.findall(done)):
                return True
        return False

    def others(self, word: str) -> set[str]:
        """The texts that the other chains make of a word, if all their characters are the language's."""
        found, into, other, out = _HIGH.findall(word), -1, 0, set()
        for c in found:
            into &= self.into.get(c, 0)
            other |= self.other.get(c, 0)
        bits = into & other
        while bits:
            low = bits & -bits
            out.add(word.translate(self.tables[low.bit_length() - 1][1]))
            bits ^= low
        raws: dict[str, bytes | None] = {}
        for wrong, right in self.multi:
            if wrong not in raws:
                raws[wrong] = _encoded(word, _maps()[wrong])
            try:
                done = (raws[wrong] or b"").decode(right)
            except UnicodeError:
                continue
            if done and all(c in self.letters for c in _HIGH.findall(done)):
                out.add(done)
        out.discard(word)
        return out


def _encoded(text: str, charmap: object) -> bytes | None:
    try:
        return codecs.charmap_encode(text, "strict", charmap)[0]
    except UnicodeEncodeError:
        return None


def _wrong(lines: list[list[str]], bad: frozenset[str] | set[str]) -> list[bool]:
    """Whether nothing is learnt from a line, for the lines beyond ASCII of a text, of which the words are given: those that hold garbled
    words, and all of a text that has these in a fifth of its lines beyond ASCII."""
    out = [not bad.isdisjoint(x) for x in lines] if bad else [False] * len(lines)
    return out if sum(out) * 5 < len(out) or not any(out) else [True] * len(out)


def _alphabet(counts: dict[str, tuple[int, int, int]]) -> dict[str, float]:
    """The characters of a language and their weights, from the numbers of texts by character: all that have it, not counting UTF-8 read
    with another codec; those that have it in any line; those that have it in a clean one. The empty character stands for all texts, those
    with lines beyond ASCII and those of which such lines are clean.

    A character's count is lowered by the share of the texts with it that have it in garbled lines only."""
    texts, lined, told = counts.get("", (0, 0, 0))
    # Texts of which nothing beyond ASCII is left say nothing about the language's own characters.
    whole = max(1.0, texts * max(told / max(1, lined), USUAL_SHARE))
    usual: dict[str, float] = {}
    for c, (n, with_it, clean) in sorted(counts.items()):
        own = n * (clean / with_it if with_it else 1)
        if c and own >= whole * USUAL_SHARE:
            for form in (c, c.lower(), c.upper()):
                if len(form) == 1:
                    usual[form] = max(usual.get(form, RAREST), math.log2(own / whole) if form == c else RAREST / 2)
    return usual


def _trained(samples: list[bytes]) -> bytes:
    """A dictionary trained on all samples; segments are of one length, as to try several takes five times as long."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=SEGMENT, d=8, split_point=1.0, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few lines to train on
        return b"\n".join(samples)[-DICTIONARY_BYTES:]


def _merged(dictionaries: list[bytes]) -> bytes:
    """One dictionary trained on the segments of several, which stand in them from the end on: what many of them hold counts most."""
    if len(dictionaries) == 1:
        return dictionaries[0]
    return _trained([x[max(0, i - SEGMENT) : i] for x in dictionaries for i in range(len(x), 0, -SEGMENT)])


def _lines(text: str) -> list[str]:
    """All lines of a text but empty ones, cut into pieces of ``PIECE`` characters."""
    return [y for x in text.splitlines() if x for y in ((x,) if len(x) <= PIECE else [x[i : i + PIECE] for i in range(0, len(x), PIECE)])]


def _taken(text: str) -> tuple[str, str, str, str]:
    """What is learnt from a text, as lines: its lines, without those of ASCII that begin with a digit; the words of those beyond ASCII,
    with blanks between them; its characters beyond ASCII; and these without UTF-8 read with another codec."""
    lines, marked, ends = [], [], set()
    for x in _lines(text):
        y = x.strip()
        if x.isascii():
            if y and not "0" <= y[0] <= "9":
                lines.append(y)
            continue
        if len(x) != len(y):
            ends.update(x)
        if not y.isascii():
            lines.append(y)
            marked.append(" ".join(_words(y)))
        elif y and not y[0].isdigit():
            lines.append(y)
    words = "\n".join(marked)
    within = set(words).union(ends) - _ASCII
    found = within
    if marked and _holds_utf8(words) and any(map(_read_wrong, set(_RUNS.findall(words)))):
        own = set(_RUNS.sub(lambda m: " " if _read_wrong(m[0]) else m[0], words))
        found = own.union(ends.difference(words)) - _ASCII  # blanks around lines are in no word
    return "\n".join(lines), words, "".join(sorted(within)), "".join(sorted(found))


def _sampled_lines(text: str) -> list[str]:
    """The lines of a text; of a long text a part of them by their hash, about ``SAMPLE_CHARS`` in all. Nothing is learnt from such a part."""
    lines = _lines(text)
    if len(text) <= SAMPLE_CHARS:
        return lines
    share = SAMPLE_CHARS / len(text) * 2**32
    return [x for x in lines if zlib.crc32(x.encode("utf-8", "surrogatepass")) < share]


def _batch(rows: list[tuple], *columns: tuple[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(columns)], names=[c for c, _ in columns])


def _garbled_words(texts: DataFrame) -> dict[str, set[str]]:
    """By language the words that a chain turns into less odd ones of its texts, or into more frequent ones that are as odd, and those that
    are UTF-8, read with another codec, of characters that are no rarity beside theirs."""
    string, long = pa.string(), pa.int64()

    def spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        rows = lambda: _batch([(k, w, n) for k, x in counts.items() for w, n in x.items()], ("k", string), ("w", string), ("n", long))
        for batch in batches:
            for k, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts.setdefault(k, Counter()).update(words.replace("\n", " ").split(" "))
            if sum(map(len, counts.values())) >= COUNTED_WORDS:
                yield rows()
                counts.clear()
        yield rows()

    def lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list] = {}
            for k, w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by.setdefault(k, []).append((w, n))
            yield _batch([(k, c, n) for k, x in by.items() for c, n in _letter_counts(x).items()], ("k", string), ("c", string), ("n", long))

    words = written(texts.where("words != ''").select("k", "words").mapInArrow(spoken, "k string, w string, n bigint").groupBy("k", "w").agg(F.sum("n").alias("n")), "words")
    letters: dict[str, dict[str, int]] = {}
    for r in words.mapInArrow(lettered, "k string, c string, n bigint").groupBy("k", "c").agg(F.sum("n").alias("n")).collect():
        letters.setdefault(r["k"], {})[r["c"]] = r["n"]
    sent = words.sparkSession.sparkContext.broadcast(letters)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Readings] = {}
        for batch in batches:
            out = []
            for k, w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k not in by:
                    by[k] = Readings(sent.value[k])
                if by[k].utf8(w):
                    out.append((k, w, n, None))
                else:
                    out += [(k, w, n, done) for done in by[k].others(w)]
            yield _batch(out, ("k", string), ("w", string), ("n", long), ("done", string))

    def odder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, w, n, done, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if done is None or (had := _oddness(w)) > (has := _oddness(done)) or had == has and m > n:
                    out.append((k, w))
            yield _batch(out, ("k", string), ("w", string))

    made = words.mapInArrow(read, "k string, w string, n bigint, done string")
    known = words.select("k", F.col("w").alias("done"), F.col("n").alias("m"))
    both = made.join(known, ["k", "done"], "left").where("done is null or m is not null").select("k", "w", "n", "done", "m")
    bad: dict[str, set[str]] = {}
    for r in both.mapInArrow(odder, "k string, w string").distinct().collect():
        bad.setdefault(r["k"], set()).add(r["w"])
    return bad


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The model of a corpus, learnt from all its distinct texts. An empty corpus gives an empty model, with which nothing is restored but by
    plain compression.

    Each text is read once; the lines and words of the distinct ones are written. From these come the words with their counts, of which
    those that chains explain better are brought to all tasks, and then the numbers of texts by character (bounded by Unicode). All clean
    lines of a language's characters meet, in parts of about ``PART_BYTES`` of texts, where a dictionary is trained on each part; the parts'
    dictionaries are merged, ``MERGED_PARTS`` at a time. Only alphabets, garbled words and dictionaries come to the driver, the last at
    most ``MOST_LANGUAGES`` of ``DICTIONARY_BYTES``."""
    name = F.lower(F.trim(F.col(lang)))
    rows = df.where(name != "").groupBy(name.alias("k")).count().orderBy(F.desc("count"), "k").limit(MOST_LANGUAGES).collect()
    order = [r["k"] for r in rows]
    if not order:
        return Model({}, {})
    listed, string, long, context = frozenset(order), pa.string(), pa.int64(), df.sparkSession.sparkContext
    taken = ("lines", "words", "within", "found")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, k, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t and k in listed:
                    out.append((k, h, len(t.encode()), *_taken(t)))
            yield _batch(out, ("k", string), ("h", long), ("size", long), *((x, string) for x in taken))

    source = spread(df.select(F.col(text).alias("t"), name.alias("k"), F.xxhash64(text).alias("h")))
    texts = source.mapInArrow(seen, "k string, h bigint, size bigint, " + ", ".join(f"{x} string" for x in taken))
    texts = written(texts.groupBy("k", "h").agg(*(F.first(c).alias(c) for c in ("size", *taken))), "texts-seen")
    bad = context.broadcast(_garbled_words(texts))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[Counter]] = {}
            for k, size, words, within, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                all_texts, lined, told, sizes = by.setdefault(k, [Counter(), Counter(), Counter(), Counter()])
                all_texts[""] += 1
                sizes[""] += size
                all_texts.update(found)
                lined.update(within)
                if words:
                    lined[""] += 1
                    lines = words.split("\n")
                    wrong = _wrong([x.split(" ") for x in lines], bad.value.get(k, frozenset()))
                    clean = "".join([x for x, w in zip(lines, wrong, strict=True) if not w])
                    told[""] += bool(clean)
                    told.update(c for c in set(clean) if c > "\x7f")
            yield _batch([(k, c, *(x[c] for x in counts)) for k, counts in by.items() for c in set().union(*counts)], ("k", string), ("c", string), *((x, long) for x in ("n", "within", "clean", "size")))

    sums = ("n", "within", "clean", "size")
    by: dict[str, dict[str, tuple]] = {}
    parts: dict[str, int] = {}
    totals = texts.select("k", "size", "words", "within", "found").mapInArrow(counted, "k string, c string, n bigint, within bigint, clean bigint, size bigint")
    for r in totals.groupBy("k", "c").agg(*(F.sum(x).alias(x) for x in sums)).collect():
        by.setdefault(r["k"], {})[r["c"]] = (r["n"], r["within"], r["clean"])
        if not r["c"]:
            parts[r["k"]] = -(-r["size"] // PART_BYTES)
    usual = {k: _alphabet(counts) for k, counts in by.items()}
    own = context.broadcast({k: _ASCII.union(x) for k, x in usual.items()})

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, h, lines, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                allowed, wrong = own.value[k], iter(_wrong([x.split(" ") for x in words.split("\n")], bad.value.get(k, frozenset())) if words else ())
                if clean := [x for x in lines.split("\n") if x and (x.isascii() or not next(wrong) and allowed.issuperset(x) and not x[0].isdigit())]:
                    out.append((k, h % parts[k], h, "\n".join(clean)))
            yield _batch(out, ("k", string), ("part", long), ("h", long), ("lines", string))

    def trained(at: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("h")
        return pd.DataFrame({"k": [at[0]], "part": [at[1]], "dictionary": [_trained([x for t in part["lines"] for x in t.encode().split(b"\n")])]})

    def merged(at: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [at[0]], "part": [at[1]], "dictionary": [_merged([bytes(x) for x in part.sort_values("part")["dictionary"]])]})

    kinds, most = "k string, part bigint, dictionary binary", max(parts.values(), default=1)
    lines = texts.select("k", "h", "lines", "words").mapInArrow(good, "k string, part bigint, h bigint, lines string").repartition(max(1, sum(parts.values())), "k", "part")  # a number of tasks that isn't coalesced
    done = written(lines.groupBy("k", "part").applyInPandas(trained, kinds), "dictionaries")
    while most > 1:
        done = done.withColumn("to", F.floor(F.col("part") / MERGED_PARTS)).groupBy("k", "to").applyInPandas(merged, kinds)
        most = -(-most // MERGED_PARTS)
    dictionaries = {r["k"]: bytes(r["dictionary"]) for r in done.collect()}
    order = [k for k in order if k in usual]
    letters = {k: "".join(sorted(usual[k])) for k in order}
    return Model(letters, {k: dictionaries[k] for k in order if dictionaries.get(k)}, {k: [usual[k][c] for c in letters[k]] for k in order})


def restored(df: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(``key``, text, chains array<string>, garbled_lines int) of every row: its text restored where possible, the decodings undone
    (``right<wrong``, first step first) and the number of lines with garbled characters, restored or not.

    Null, empty and unmistakable texts come out unchanged with no chain. U+FFFD, a lost character, counts as garbled. A null or unknown
    language is detected by the dictionaries. Whole texts are read, of any length; repeated rows are treated alike."""
    model = model or fit(df, key, text, lang)
    parts = (model.usual, model.dictionaries, model.weights)
    content = pickle.dumps(parts)
    name = ("mojibake", hashlib.sha256(content).hexdigest())
    sent = df.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = kept(name, lambda: Restorer(Model(*sent.value))).restore
        for batch in batches:
            texts, chains, lines = [], [], []
            for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                done = restore(t, k) if t and not t.isascii() else (t, [], 0)
                for out, x in zip((texts, chains, lines), done, strict=True):
                    out.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(chains, pa.list_(pa.string())), pa.array(lines, pa.int32())], names=[key, "text", "chains", "garbled_lines"])

    kind = dict(df.dtypes)[key]
    return spread(df.select(key, text, lang)).mapInArrow(run, f"`{key}` {kind}, text string, chains array<string>, garbled_lines int")
