"""Noise cleaner: a scanner over the pieces of a message between blanks.

Every piece gets a kind (retweet mark, user, mail, link, smiley, plain) from small
recognisers; the sequence of kinds decides what is deleted and what becomes a
placeholder; what is left of a piece is tidied character by character. The result of the scan is a
list of edits that do not overlap, so no conflicts between rules have to be solved.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Placeholders (fixed values).
USER, MAIL, LINK = "%User", "%Mail", "%Link"
POSITIVE, NEGATIVE, IRONIC, NEUTRAL = "%PosSmiley", "%NegSmiley", "%IronicSmiley", "%Smiley"
#: Retweet marks (fixed values).
RETWEET = {"RT", "MT"}
#: Punctuation removed at the start of a message and around the core of a piece.
LEADING, OPENING, CLOSING = ".?!:;", "\"'([{„“»«‚‘", "\"')]}.,:;!?“”«»‘’"
SENTENCE_END = tuple(".!?\"'“”")
#: Top-level names by which a bare host is recognised as a link.
HOSTS = {"de", "at", "ch", "eu", "com", "net", "org", "info", "io", "fr", "nl", "it", "es", "uk", "tv", "me", "ly"}
#: Marks of lists, without meaning for the text.
BULLETS = set("•◦‣▪●►➤👉💤")
#: A row without any of these needs no scan (Java regular expression).
SUSPECT = r"[@#_•◦‣▪●►➤]|https?:|www\.|\p{L}\.\p{L}|\.{4}|![!?]|^\s*[.?!:;]|[:;=8xX][-o^'*)\](\[{}DdPp3/\\|<>oO0]|\^|<3|&lt;3|-_-|[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]|\b[RM]T\b"

_PIECE = re.compile(r"\S+")
#: Pieces up to this length are remembered; what a piece is and what is edited inside it depend on its characters alone.
REMEMBERED = 40


def is_user(core: str) -> bool:
    return len(core) > 1 and core[0] == "@" and all(c.isalnum() or c == "_" for c in core.lstrip("@")) and core.strip("@") != ""


def is_mail(core: str) -> bool:
    name, at, host = core.partition("@")
    return bool(at and name and "." in host.strip(".") and all(c.isalnum() or c in ".+-_" for c in name) and all(c.isalnum() or c in ".-" for c in host))


def is_link(core: str) -> bool:
    low = core.lower()
    if low.startswith(("http://", "https://", "www.")):
        return len(low) > 8
    host = re.split(r"[/?#:]", low, maxsplit=1)[0]
    labels = host.split(".")
    return len(labels) > 1 and labels[-1] in HOSTS and all(x and all(c.isalnum() or c == "-" for c in x) for x in labels) and any(c.isalpha() for c in labels[-2])


def smiley(piece: str) -> str | None:
    """Class of a smiley made of eyes, an optional nose and a mouth, of faces like ^^ and of hearts."""
    if piece in ("<3", "&lt;3"):
        return POSITIVE
    if len(piece) >= 2 and piece[0] == piece[-1] and piece[0] in "^-" and piece.strip("^-") in ("", "_", ".", "_" * (len(piece) - 2)):
        if piece[0] == "^":
            return POSITIVE
        return NEGATIVE if len(piece) > 2 and "_" in piece else None
    eyes, rest = piece[:1], piece[1:]
    if eyes in ("x", "X"):
        return POSITIVE if rest and set(rest) <= {"D", "d"} and rest[0] == "D" else None
    if eyes == "o" or eyes == "O":
        return NEUTRAL if rest.lstrip("._-") in ("O", "o") and rest[:1] in "._-" else None
    if not eyes or eyes not in ":;=8":
        return None
    nose = rest[:1] in ("-", "o", "^", "'", "’") and len(rest) > 1
    rest = rest[1:] if nose else rest
    if eyes == "8" and not nose:
        return None
    if not rest or len(set(rest)) > 1:
        return None
    mouth = rest[0]
    if mouth in "pP":
        return IRONIC
    if mouth in ")]}D*":
        return IRONIC if eyes == ";" else POSITIVE
    if mouth in "([{/\\|<" or mouth in "cC" and eyes == ":":
        return NEGATIVE
    return NEUTRAL if mouth in "oO0" and len(rest) == 1 else None


#: Words of Unicode character names that tell the mood of an emoji, in the order they are tried.
MOODS = (
    (IRONIC, ("SMIRKING", "TONGUE", "WINKING", "GRIMACING", "ROLLING EYES", "UPSIDE-DOWN", "WRY SMILE")),
    (NEGATIVE, ("CRYING", "ANGRY", "POUTING", "WEARY", "FEARFUL", "DISAPPOINTED", "UNAMUSED", "CONFOUNDED", "PERSEVERING", "FROWN", "ANGUISHED", "SCREAMING", "TIRED", "WORRIED", "COLD SWEAT", "PENSIVE", "THUMBS DOWN", "BROKEN HEART", "TRIUMPH")),
    (POSITIVE, ("SMILING", "GRINNING", "TEARS OF JOY", "KISS", "HEART", "THUMBS UP", "PARTY", "SAVOURING", "RELIEVED", "HUGGING", "CLAPPING", "HAPPY")),
)


@lru_cache(maxsize=4096)
def emoji(char: str) -> str | None:
    """Class of an emoji by its Unicode name; None for what shows no mood."""
    if ord(char) < 0x2600:
        return None
    name = unicodedata.name(char, "")
    return next((mood for mood, words in MOODS if any(w in name for w in words)), None)


class NoiseCleaner:
    """``edits`` of a message; ``clean`` applies them and notes placeholders in a log."""

    def edits(self, text: str) -> list[tuple[int, int, str]]:
        start = len(text) - len(text.lstrip(LEADING))
        if start and smiley(text.split(maxsplit=1)[0]):
            start = 0
        elif start:
            start = len(text) - len(text[start:].lstrip())
        out = [(0, start, "")] if start else []  # with the blanks behind it
        pieces, kinds, insides = [], [], []
        for m in _PIECE.finditer(text, start):
            piece = m.group()
            kind, inside = _known(piece) if len(piece) <= REMEMBERED else _read(piece)
            pieces.append(m.span())
            kinds.append(kind)
            insides.append(inside)
        gone = self._deleted(text, pieces, kinds)
        at = 0
        while at < len(pieces):
            if at in gone:
                first = at
                while at in gone:
                    at += 1
                # a deleted run takes the blank behind it along, at the end of the text the one before it
                a = pieces[first][0] if at < len(pieces) or not first else pieces[first - 1][1]
                out.append((a, pieces[at][0] if at < len(pieces) else len(text), ""))
                continue
            if insides[at]:
                a = pieces[at][0]
                out += [(a + i, a + j, new) for i, j, new in insides[at]]
            at += 1
        return out

    @staticmethod
    def _core(text: str, a: int, b: int) -> tuple[int, int]:
        while a < b and text[a] in OPENING:
            a += 1
        while b > a and text[b - 1] in CLOSING:
            b -= 1
        return a, b

    @staticmethod
    def _kind(text: str, piece: tuple[int, int], core: tuple[int, int]) -> str:
        whole, inner = text[slice(*piece)], text[slice(*core)]
        if whole.rstrip(":") in RETWEET:
            return "mark"
        if smiley(whole):
            return "smiley"
        if is_user(inner):
            return "user" if piece[0] == core[0] else "quoted user"
        if is_mail(inner):
            return "mail"
        if is_link(inner):
            return "link" if piece == core else "quoted link"
        return "joint" if whole in ("-", "|", ":", "–") else "plain"

    @staticmethod
    def _deleted(text: str, pieces: list, kinds: list[str]) -> set[int]:
        """Numbers of the pieces that go altogether."""
        gone: set[int] = set()
        n, at = len(pieces), 0
        while at < n:
            end = at
            while end < n and kinds[end] in ("mark", "user"):
                end += 1
            if end == at:
                at += 1
                continue
            run = list(range(at, end))
            users = [i for i in run if kinds[i] == "user"]
            opens = at == 0 or text[pieces[at - 1][0] : pieces[at - 1][1]].endswith(SENTENCE_END)
            if users and (opens and (end < n or at > 0) or any(kinds[i] == "mark" for i in run)):
                first = at if opens else next(i for i in run if kinds[i] == "mark")
                gone.update(i for i in run if i >= first)
            at = end
        last = n - 1
        while last >= 0 and kinds[last] == "link":
            gone.add(last)
            last -= 1
        if gone and last + 1 in gone and last >= 0 and kinds[last] == "joint" and last + 1 < n and kinds[last + 1] == "link":
            gone.add(last)
        return gone if len(gone) < n else set()

    @staticmethod
    def _inside(text: str, piece: tuple[int, int], core: tuple[int, int], kind: str) -> list[tuple[int, int, str]]:
        (a, b), (c, d) = piece, core
        if kind == "smiley":
            return [(a, b, smiley(text[a:b]))]
        named = {"user": USER, "mail": MAIL, "link": LINK}.get(kind.rpartition(" ")[2])
        if named:
            return [*NoiseCleaner._tidied(text, a, c), (c, d, named), *NoiseCleaner._tidied(text, d, b)]
        return NoiseCleaner._tidied(text, a, b)

    @staticmethod
    def _tidied(text: str, a: int, b: int) -> list[tuple[int, int, str]]:
        """Hash marks and underscores around words, long runs of end marks, bullets and emoji."""
        out, i = [], a
        while i < b:
            char, j = text[i], i + 1
            if char in "#_":
                while j < b and text[j] in "#_":
                    j += 1
                inside = i > a and text[i - 1].isalnum() and j < b and text[j].isalnum()
                if not inside and (i > a and text[i - 1].isalnum() or j < b and text[j].isalnum()):
                    out.append((i, j, ""))
            elif char == ".":
                while j < b and text[j] == ".":
                    j += 1
                if j - i > 3:
                    out.append((i + 3, j, ""))
            elif char == "!":
                while j < b and text[j] in "!?":
                    j += 1
                if j - i > 1:
                    out.append((i + 1, j, ""))
            elif char in BULLETS:
                out.append((i, j, ""))
            elif ord(char) >= 0x2600 and (mood := emoji(char)):
                if j < b and text[j] == "️":
                    j += 1
                out.append((i, j, mood))
            i = j
        return out

    def clean(self, text: str, log=None) -> str:
        out, size, at = [], 0, 0
        for start, end, new in self.edits(text):
            out += [text[at:start], new]
            size += start - at
            if log is not None and text[start:end] != new:
                log.append(size, text[start:end], new)
            size += len(new)
            at = end
        return "".join([*out, text[at:]])


def _read(piece: str) -> tuple[str, tuple[tuple[int, int, str], ...]]:
    """Kind of a piece and the edits inside it, counted from its start."""
    span = (0, len(piece))
    core = NoiseCleaner._core(piece, *span)
    kind = NoiseCleaner._kind(piece, span, core)
    return kind, tuple(NoiseCleaner._inside(piece, span, core, kind))


_known = lru_cache(maxsize=50_000)(_read)
