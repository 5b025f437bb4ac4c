r"""Java patterns with exactly the matches of the Python patterns in ``veilwork.patterns``.

Java's own ``\w \d \s \b`` differ from Python's, with or without ``(?U)``: combining marks count
as word characters in Java only, superscripts and other numerals in Python only, and ``\x1c-\x1f``
are white space in Python only. A redactor that misses a number next to a Hindi vowel sign leaks
it, so the classes are spelled out. Boundaries become a look-behind that runs only after a cheap
look-ahead, which keeps prose with no candidates fast.
"""

from __future__ import annotations

import re

WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
# The characters str.isspace() accepts: as they are for btrim, and as the inside of a class. Latin
# ones stand singly there because Java looks those up in a bit set.
_SPACE_CODES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE_CHARS = "".join(map(chr, _SPACE_CODES))
SPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

NOT_AFTER_WORD = f"(?<![{WORD}])"
AFTER_WORD = f"(?<=[{WORD}])"
NOT_BEFORE_WORD = f"(?![{WORD}])"
BEFORE_WORD = f"(?=[{WORD}])"


def _starts_at(first: str) -> str:
    """Word boundary before a character of ``first``, all of them word characters."""
    return f"(?=[{first}]){NOT_AFTER_WORD}"


_PHONE_LEAD = rf"+\-.({SPACE}"

PII_JAVA = {
    "email": (
        rf"(?:{_starts_at('A-Za-z0-9_')}|(?=[.%+\-]){AFTER_WORD})"
        r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}"
        rf"(?:(?<=[A-Za-z]){NOT_BEFORE_WORD}|(?<=\|){BEFORE_WORD})"
    ),
    # At most four characters come between the start and the first digit.
    "phone": (
        rf"(?![a-zA-Z])(?=[{_PHONE_LEAD}]{{0,4}}{DIGIT})(?:{_starts_at(DIGIT)}|(?!{DIGIT}){AFTER_WORD})"
        rf"(?:\+{DIGIT}{{1,2}}[{SPACE}]?)?1?-?\.?[{SPACE}]?"
        rf"\(?{DIGIT}{{3}}\)?[{SPACE}.\-]?{DIGIT}{{3}}[{SPACE}.\-]?{DIGIT}{{4}}{NOT_BEFORE_WORD}"
    ),
    "ssn": rf"{_starts_at(DIGIT)}{DIGIT}{{3}}-{DIGIT}{{2}}-{DIGIT}{{4}}{NOT_BEFORE_WORD}",
    "credit_card": (
        rf"{_starts_at(DIGIT)}{DIGIT}{{4}}(?:[- ]?{DIGIT}{{4}}){{3}}{NOT_BEFORE_WORD}"
    ),
    "iban": (
        rf"{_starts_at('A-Z')}[A-Z]{{2}}{DIGIT}{{2}}(?:[{SPACE}\-]?[A-Z{DIGIT}]{{4}}){{3}}"
        rf"[{SPACE}\-]?[A-Z{DIGIT}]{{1,4}}{NOT_BEFORE_WORD}"
    ),
}

# Part of every phone match, quick to rule out; a text without it is left as it is.
PHONE_NEED = rf"{DIGIT}{{3}}[{SPACE}.\-]?{DIGIT}{{4}}"
# Part of every match of any kind but e-mail, in one look: the digits of a phone, social security
# or card number, or two digits after two capitals. A year or a price is none of these.
PII_DIGITS_NEED = (
    rf"{DIGIT}{{2}}(?:{DIGIT}(?:[{SPACE}.\-]?{DIGIT}{{4}}|-{DIGIT}{{2}}-|{DIGIT}[- ]?{DIGIT}{{4}})"
    rf"|(?<=[A-Z]{{2}}{DIGIT}{{2}}))"
)

# Only the presence of a match matters here, so each pattern is the shortest one that matches
# somewhere exactly when the full one does; none of them backtracks over long prose.
_TEXT = f"{WORD}{SPACE}"
TABLE_JAVA = {
    "p1": rf"\|[{_TEXT}]+\|",
    "p2": r"\+-+\+",
    "p3": rf"[{_TEXT}][{SPACE}]\|[{SPACE}][{_TEXT}]",
    "p4": (
        rf"[tT](?<![{WORD}].)(?:(?iu:able|ab|bl){NOT_BEFORE_WORD}|(?iu:ab)\.{BEFORE_WORD})"
    ),
    "p5": rf"[{SPACE}]{{4}}[{_TEXT}]+?[{SPACE}]{{4}}[{_TEXT}]",
    "p6": rf"\t[{_TEXT}]+?\t[{_TEXT}]",
}

# A character every match of a pattern contains.
TABLE_NEEDS = {"p1": "|", "p2": "+-", "p3": "|", "p6": "\t"}

WIDE_GAP_JAVA = rf"[{SPACE}]{{3,}}"
TWO_NUMBERS_JAVA = rf"{DIGIT},*[{SPACE}]+{DIGIT}"
SPACE_RUN_JAVA = rf"[{SPACE}]+"
# str.splitlines() breaks, then commas.
TERM_BREAK_JAVA = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]|,"
IMAGE_REFERENCE_JAVA = rf"\[Image:[{SPACE}]*([^\n]*?)\]|!\[([^\n]*?)\]"


def _case_key(char: str) -> str:
    """Equal for two characters exactly when they match each other without regard to case."""
    upper = char.upper()
    return (upper if len(upper) == 1 else char).lower()[0]


# Splits on one path through a list of terms; what is longer is listed plainly from there on.
_DEEPEST = 40


def _by_first(terms) -> tuple[list[list[str]], bool]:
    """Terms in groups that start alike, and whether the list ends in an empty one.

    An empty rest fits wherever it is tried, so what is listed after it never wins.
    """
    groups: dict[str, list[str]] = {}
    for term in terms:
        if not term:
            return list(groups.values()), True
        groups.setdefault(_case_key(term[0]), []).append(term)
    return list(groups.values()), False


def _branch(group: list[str], depth: int) -> str:
    """What all terms of a group start with, then their rests."""
    keys = [list(map(_case_key, term)) for term in group]
    shared = 0
    for column in zip(*keys):
        if len(set(column)) > 1:
            break
        shared += 1
    rest = _tree([term[shared:] for term in group], depth + 1)
    return re.escape(group[0][:shared]) + (f"(?:{rest})" if rest else "")


def _tree(terms, depth: int = 0) -> str:
    if depth == _DEEPEST:
        return "|".join(map(re.escape, terms))
    groups, ended = _by_first(terms)
    return "|".join([_branch(group, depth) for group in groups] + [""] * ended)


def alternation(terms) -> str:
    """Case-insensitive pattern: the first listed term that fits wins, no word boundaries.

    Terms become a tree of shared beginnings. Terms that differ in a character never fit at the
    same place, so only the order within a branch matters and that is kept; a place in the text is
    tried against the one branch that can fit instead of every term.
    """
    firsts = "".join(re.escape(group[0][0]) for group in _by_first(terms)[0])
    return f"(?iu)(?=[{firsts}])(?:{_tree(terms)})"
