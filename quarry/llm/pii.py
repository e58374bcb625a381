"""Personal data: generators propose spans, boosted trees choose among them.

Four exact kinds (email, ip, card, phone) are found by pattern and validation and always stay. For what
they leave, high-recall generators propose overlapping candidates: spelled-out addresses, numbers that
look like phones, national ids, accounts, cards in other writing, IPv6 addresses and tokens. Trees score
each by its format (digits, separators, checksums, grouping) and by words of its context; scores above
the generator's calibrated threshold become spans, best first where they overlap.

Generators see the text with the exact kinds' spans blanked out, so what they propose ends where such a
span begins. Numbers are proposed at several starts and lengths: cards as every part of a number run at
group borders that has 12 to 19 digits and passes Luhn, phones from a ``+`` with 9 to 15 digits, other
phones with three to five groups. So a number is found though its run as a whole fails the exact check.

All of it is one expression over the text: built-in functions, no shuffle, no Python on executors. The
trees are fitted in the driver on ``EXAMPLES`` sentences made by rule, whose features come from the same
expressions, and become ``CASE`` expressions.

Patterns are rewritten so that no text makes them backtrack: runs are possessive and start at run
starts (or where the last match ended), which finds the same leftmost matches. Places are running sums
in blocks, contexts are cut from pieces of the text, and overlaps are settled within groups of spans that
meet, so that the work is in proportion to a text's length and its proposals.

Offsets are code points, ends exclusive. Defined results: a null text is empty and has no spans; repeated
rows get equal results; other columns are never read.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import gbt
from quarry.llm.common import let

KINDS = ["email", "ip", "card", "phone", "secret", "ssn", "iban"]
EXAMPLES = 2400
CONTEXT = 40
PRECISION = 0.97
#: Calibrated scores that a threshold may have.
LEVELS = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)

BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # runs of 12 digits or more; shorter runs would be dropped by the check of the number of digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){11}(?:[\x20-]?+[0-9])*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_GROUPED = r"(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .()-]{1,2}[0-9]{2,4})"
_DIGITS = r"[0-9](?:[ ./_·-]?+[0-9])"
#: (kind, pattern); a generator's number is its place, and between equal scores the first wins. From
#: ``PARTS`` on a pattern finds number runs, of which ``_parts`` proposes pieces.
GENERATORS: list[tuple[str, str]] = [
    ("email", r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]++ ?(?:\[at\]|\(at\)|\{at\}|<at>) ?[A-Z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}|<dot>) ?[A-Z0-9-]++)++"),
    ("ssn", r"(?<![\w-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![\w-])"),
    ("phone", rf"(?<![\w+./-]){_GROUPED}{{2,4}}(?![\w-])"),
    ("iban", r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    ("secret", r"(?<![\w+/=-])(?=[A-Za-z_+/=-]*+[0-9])[\w+/=-]{20,}+"),
    ("card", r"(?<![0-9.])[0-9]{4}(?:[./_·][0-9]{4}){3}(?![0-9])"),
    ("ip", r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    ("card", rf"(?<![0-9]){_DIGITS}{{11}}(?:[ ./_·-]?+[0-9])*+"),
    ("phone", BASE["phone"]),
    ("phone", r"(?<![0-9])\(?[0-9]++(?:[ .()-]{1,2}[0-9]++){2,}+"),
]
#: Generators from here on propose parts of number runs and have trees of their own.
PARTS = 7
#: The pieces that start at a place of a run, as group 1: patterns over the text from one character
#: before the place. A card's piece has at most 19 digits and 18 separators, a grouped phone 30 characters.
PIECES = {
    7: [rf"^[^0-9]({_DIGITS}{{{n - 1}}})(?![0-9])" for n in range(12, 20)],
    8: [rf"^(?s:.)(\+[0-9](?:[ ().-]*+[0-9]){{{n - 1}}})(?![0-9])" for n in range(9, 16)],
    9: [rf"^(?:[^\w+./(-]|\((?![0-9]{{2,4}}\)))({_GROUPED}{{{n}}})(?![\w-])" for n in range(2, 5)],
}
REACH = 40
#: Words that speak for private data, and words that speak for other numbers.
CONTEXT_WORDS = {
    "contact": r"(?i)\b(phone|tel|call|mobile|cell|fax|contact|reach|whatsapp|text me|telefon|handy|t[eé]l|llam)",
    "mail": r"(?i)\b(mail|e-?mail|write|address|correo|courriel)",
    "identity": r"(?i)\b(ssn|social security|tax id|national id|insurance)",
    "bank": r"(?i)\b(iban|account|bank|konto|compte|cuenta|transfer|card|visa|mastercard|credit)",
    "credential": r"(?i)\b(token|secret|password|passwd|api|key|bearer|auth|credential)",
    "other": r"(?i)\b(order|isbn|part|serial|version|page|commit|sha|hash|checksum|md5|invoice|ticket|item|sku|figure|table|score|build|digest|id)\b",
    "host": r"(?i)\b(server|host|ip|addr|client|login|from)",
}


SPAN = "struct<start:int,kind:int,end:int,gen:int,m:string>"
#: Elements that a fold may append to one array, each append being a copy of it.
BLOCK = 64
#: Code points of a piece of text in which a place is sought.
CHUNK = 256


def _running(values: Column, join: Callable[[Column, Column], Column], long: bool = True) -> Column:
    """The running results of an associative operation over an array of ints, in blocks, so that the work
    stays in proportion to the array up to millions of elements. Not ``long``, it is one fold: the plan is
    smaller, and enough for sentences."""

    def fold(a: Column) -> Column:
        none = F.array().cast("array<int>")
        return F.aggregate(a, none, lambda acc, x: F.concat(acc, F.array(F.coalesce(join(F.get(acc, F.size(acc) - 1), x), x))))

    def level(a: Column, deeper: int) -> Column:
        def blocks(whole: Column) -> Column:
            parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / BLOCK)), lambda i: fold(F.slice(whole, (i * BLOCK + 1).cast("int"), F.lit(BLOCK))))

            def moved(done: Column) -> Column:
                ends = level(F.transform(done, lambda b: F.get(b, F.size(b) - 1)), deeper - 1)
                return let(ends, lambda e: F.flatten(F.transform(done, lambda b, k: F.when(k == 0, b).otherwise(F.transform(b, lambda x: join(F.get(e, k - 1), x))))))

            return let(parts, moved)

        return let(a, lambda w: F.when(F.size(w) <= BLOCK, fold(w)).otherwise(blocks(w))) if deeper else fold(a)

    return level(values, int(long))


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _cut(chunks: Column, at: Column, n: int | Column) -> Column:
    """``n`` characters (``CHUNK`` at most) from place ``at`` on, found without a walk from the start."""
    k = F.floor(at / CHUNK).cast("int")
    near = F.concat(F.coalesce(F.get(chunks, k), F.lit("")), F.coalesce(F.get(chunks, k + 1), F.lit("")))
    return F.substring(near, at % CHUNK + 1, n if isinstance(n, Column) else F.lit(n))


def _stretch(chunks: Column, at: Column, n: Column) -> Column:
    """Any number of characters from place ``at`` on."""
    part = F.slice(chunks, F.floor(at / CHUNK).cast("int") + 1, F.floor(n / CHUNK).cast("int") + 2)
    return F.when(n > 0, F.substring(F.array_join(part, ""), at % CHUNK + 1, n)).otherwise(F.lit(""))


def _replaced(text: Column, spans: Column, mark: Callable[[Column, Column], Column], long: bool = True) -> Column:
    """The text with ``mark(span, end of the spans before it)`` in the place of each of the sorted spans."""

    def of(chunks: Column) -> Column:
        def pieces(ends: Column) -> Column:
            before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
            made = F.transform(spans, lambda s, i: F.concat(_stretch(chunks, before(i), s["start"] - before(i)), mark(s, before(i))))
            return F.concat(F.array_join(made, ""), let(before(F.size(spans)), lambda at: _stretch(chunks, at, F.length(text) - at)))

        return let(_running(F.transform(spans, lambda s: s["end"]), F.greatest, long), pieces)

    return F.when(F.size(spans) > 0, let(_chunks(text), of)).otherwise(text)


def _spans(text: Column, pattern: str, kind: int, gen: int = -1, long: bool = True) -> Column:
    """Leftmost matches with their places: lengths of what lies between and of matches, summed up."""
    empty = F.array().cast(f"array<{SPAN}>")

    def of(matches: Column) -> Column:
        def placed(gaps: Column) -> Column:
            steps = F.transform(matches, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
            return let(_running(steps, lambda a, b: a + b, long), lambda ends: F.transform(matches, lambda m, i: F.struct(
                (F.get(ends, i) - F.length(m)).alias("start"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"), F.lit(gen).alias("gen"), m.alias("m")
            )))

        return F.when(F.size(matches) > 0, let(F.split(text, pattern, -1), placed)).otherwise(empty)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def _parts(text: Column, kind: int, gen: int, long: bool = True) -> Column:
    """Every piece of every number run that ``PIECES`` allows; pieces overlap."""

    def at(place: Column, near: Column) -> Column:
        made = F.transform(F.array(*[F.regexp_extract(near, p, 1) for p in PIECES[gen]]), lambda m: F.struct(
            place.alias("start"), F.lit(kind).alias("kind"), (place + F.length(m)).alias("end"), F.lit(gen).alias("gen"), m.alias("m")
        ))
        return F.filter(made, lambda s: (s["m"] != "") & luhn(_digits(s["m"])) if gen == 7 else s["m"] != "")

    def of(runs: Column, chunks: Column) -> Column:
        def run_of(run: Column) -> Column:
            # places of a group's first digit or bracket; what is near begins one character before
            starts = _spans(run["m"], r"(?<![0-9])[0-9]|[(]", kind, long=long)
            return F.flatten(F.transform(starts, lambda s: let(run["start"] + s["start"], lambda p: let(_cut(chunks, p, REACH), lambda near: at(p, near)))))

        return F.flatten(F.transform(runs, run_of))

    def some(runs: Column) -> Column:
        if gen == 8:  # separators may be many, and a run has one plus
            return F.flatten(F.transform(runs, lambda run: at(run["start"], F.concat(F.lit(" "), run["m"]))))
        return let(_chunks(F.concat(F.lit(" "), text)), lambda chunks: of(runs, chunks))

    return let(_spans(text, GENERATORS[gen][1], kind, gen, long), lambda runs: _gated(F.size(runs) > 0, some(runs)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -(i + 1), F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid_ip(m: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(m, r"\."), small)


def _valid_card(m: Column) -> Column:
    d = _digits(m)
    return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)


def _valid_phone(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


VALID: dict[str, Callable[[Column], Column]] = {"ip": _valid_ip, "card": _valid_card, "phone": _valid_phone}
GATE = {"email": "@", "phone": "+", "ip": ".", "card": ""}


def _gated(gate: Column, spans: Column) -> Column:
    return F.when(gate, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column, numeric: Column, long: bool = True) -> Column:
    """The exact kinds' spans, by start and then kind. ``numeric``: whether the text has a digit."""
    found = []
    for kind, pattern in BASE.items():
        spans = _spans(text, pattern, KINDS.index(kind), long=long)
        if kind in VALID:
            valid = VALID[kind]
            spans = F.filter(spans, lambda s: valid(s["m"]))  # noqa: B023  called at once
        found.append(_gated(F.contains(text, F.lit(GATE[kind])) & (F.lit(True) if kind == "email" else numeric), spans))
    return F.array_sort(F.transform(F.concat(*found), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def blanked(text: Column, base: Column, long: bool = True) -> Column:
    """The text with a line break, which no generator takes, for each character of a base span."""
    return _replaced(text, base, lambda s, before: F.repeat(F.lit("\n"), F.greatest(s["end"] - F.greatest(before, s["start"]), F.lit(0))), long)


def candidates(text: Column, numeric: Column, gens: range = range(len(GENERATORS)), long: bool = True) -> Column:
    """The proposals of generators, of all by default, with the matched string as ``m``."""
    spelled = text.rlike(r"(?i)[\[({<]at[\])}>]")
    made = []
    for g in gens:
        k, p = GENERATORS[g]
        kind = KINDS.index(k)
        made.append(_gated(spelled if g == 0 else numeric, _parts(text, kind, g, long) if g >= PARTS else _spans(text, p, kind, g, long)))
    return F.concat(*made)


FEATURES = (
    "gen", "length", "digits", "letters", "upper", "separators", "groups", "longest_group", "distinct", "hex", "luhn", "mod97", "ssn_area",
    "parens", *CONTEXT_WORDS, "other_before", "quoted", "assigned", "money", "card_groups", "phone_groups", "after_plus", "run_before", "run_after", "glued",
)


def _mod97(m: Column) -> Column:
    """Remainder of an account number's check, letters as numbers from 10."""
    bare = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substring(bare, 5, 100), F.left(bare, F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code.between(48, 57), (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def feature_columns(chunks: Column, c: Column) -> list[Column]:
    """``FEATURES`` of a candidate in the text whose ``_chunks`` are given."""
    m, start, end = c["m"], c["start"], c["end"]
    before = _cut(chunks, F.greatest(start - CONTEXT, F.lit(0)), F.least(start, F.lit(CONTEXT)))
    after = _cut(chunks, end, CONTEXT)
    around = F.concat(before, F.lit(" "), after)
    digits = _digits(m)
    groups = F.filter(F.split(m, "[^A-Za-z0-9]+"), lambda g: g != "")
    number = lambda b: F.when(b, 1.0).otherwise(0.0)
    size = lambda p: F.length(F.regexp_replace(m, p, "")).cast("double")
    return [
        c["gen"].cast("double"),
        F.length(m).cast("double"),
        F.length(digits).cast("double"),
        size("[^A-Za-z]"),
        size("[^A-Z]"),
        size("[A-Za-z0-9]"),
        F.size(groups).cast("double"),
        F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)).cast("double"),
        F.size(F.array_distinct(F.split(F.left(m, F.lit(200)), ""))).cast("double"),
        number(m.rlike("^[0-9a-f]+$")),
        number(F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)),
        number(F.when((c["gen"] == 3) & (F.length(m) < 60), _mod97(m) == 1).otherwise(False)),
        number(digits.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")),
        number(F.contains(m, F.lit("("))),
        *[number(around.rlike(p)) for p in CONTEXT_WORDS.values()],
        number(before.rlike(CONTEXT_WORDS["other"] + r"\W*(?:no|number|nr)?[\W]*$")),
        number(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        number(before.rlike("[=:]\\s*[\"'`]?$")),
        number(before.rlike("[$€£#]\\s?$")),
        number(m.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}([ ./_·-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})$")),
        number(m.rlike(r"^\+?[0-9]{0,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{4}$")),
        number(before.rlike(r"\+[0-9]{1,3}[ .-]?\(?$")),
        number(before.rlike("[0-9][ ().-]+$")),
        number(after.rlike("^[ ().-]+[0-9]")),
        number(before.rlike("[A-Za-z_]$") | after.rlike("^[A-Za-z_]")),
    ]


# --- fitting --------------------------------------------------------------------------------------


def _examples(n: int, seed: int = 20) -> list[tuple[str, int]]:
    """(sentence, label): label 1 if its candidate is private. Made by rule, the same every time."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghkmnpqrstuvwxyz0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 8)))
    fill = lambda: " ".join(name() for _ in range(r.randint(0, 5)))

    def account() -> str:
        country = r.choice(["DE", "FR", "ES", "GB"])
        body = d(18)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        whole = f"{country}{check:02d}{body}"
        return whole if r.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))

    def phone() -> str:
        return r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(3)} {d(4)}", f"0{d(3)} {d(4)} {d(2)}"])

    def card() -> str:
        body = "4" + d(14)
        total = sum(int(c) if i % 2 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(body))
        whole = body + str(-total % 10)
        return r.choice("._/").join(whole[i : i + 4] for i in range(0, 16, 4))

    address = lambda: f"{name()}{r.choice(['[at]', ' (at) ', ' [at] ', '{at}'])}{name()}{r.choice(['.', ' [dot] ', '(dot)'])}com"
    ssn = lambda: f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"
    six = lambda: ":".join(hexes(4) for _ in range(8))
    yes = [
        lambda: f"{r.choice(['write to', 'mail', 'contact', ''])} {address()}",
        lambda: f"{r.choice(['call', 'phone', 'tel:', 'my mobile is', 'contact'])} {phone()}",
        lambda: f"{r.choice(['SSN', 'social security number', 'tax id'])} {ssn()}",
        lambda: f"{r.choice(['IBAN', 'bank account', 'transfer to', ''])} {account()}",
        lambda: f'{r.choice(["token", "api key", "secret", "password"])}{r.choice([" = ", ": ", "="])}"{r.choice([hexes(40), hexes(32), mixed(r.randint(20, 44))])}"',
        lambda: f"{r.choice(['card', 'visa', 'pay with'])} {card()}",
        lambda: f"{r.choice(['server', 'host', 'from', 'login from', ''])} {six()}",
    ]
    no = [
        lambda: f"{r.choice(['order', 'part', 'serial', 'ticket', 'item'])} {r.choice([phone(), ssn()])}",
        lambda: f"{r.choice(['scores', 'years', 'rows', 'table', ''])} {' '.join(d(r.randint(2, 4)) for _ in range(r.randint(3, 5)))}",
        lambda: f"{r.choice(['on', 'until', ''])} {d(4)}-{d(2)}-{d(2)} {d(2)}.{d(2)}",
        lambda: f"{r.choice(['ISBN', 'isbn no'])} {d(3)}-{d(2)}-{d(4)}",
        lambda: f"{r.choice(['commit', 'sha', 'md5', 'hash', 'checksum', 'digest'])} {r.choice([hexes(40), hexes(32)])}",
        lambda: f"{r.choice(['see', '', 'file'])} {name()}-{name()}-{name()}-{name()}-{d(1)}",
        lambda: f"{r.choice(['', 'the'])} {'_'.join(name() for _ in range(5))}_v{d(1)}",
        lambda: f"{r.choice(['serial', 'sku', 'part'])} {r.choice(['AB', 'XK', 'QZ'])}{d(2)} {d(4)} {d(4)} {d(4)}",
        lambda: f"{r.choice(['build', 'version'])} {d(4)}.{d(4)}.{d(4)}.{d(4)}",
        lambda: f"{r.choice(['meet', 'look'])} {name()}(at){name()}.{name()}" if r.random() < 0.1 else f"page {d(2)} {d(2)} {d(3)}",
    ]
    out = []
    for i in range(n):
        label = i % 2
        out.append((f"{fill()} {r.choice(yes if label else no)()} {fill()}", label))
    return out


def _number_examples(n: int, seed: int = 21) -> list[tuple[str, list[str]]]:
    """(sentence, private numbers): numbers that stand beside others, so that proposals overlap and only
    those that are exactly a private number count. Made by rule, the same every time."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    name = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 8)))
    fill = lambda: " ".join(name() for _ in range(r.randint(0, 5)))

    def card() -> str:
        body = d(15)
        total = sum(int(c) if i % 2 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(body))
        whole = body + str(-total % 10)
        return r.choice(["", "", " ", "-"]).join(whole[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        return r.choice([f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"+{d(1)}-{d(3)}-{d(3)}-{d(4)}"])

    def local() -> str:
        return r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(3)} {d(4)}"])

    def beside() -> str:
        return r.choice([d(3), d(4), d(5), d(10), f"{d(4)}-{d(2)}-{d(2)}", f"{d(3)}.{d(3)}.{d(2)}.{d(3)}", f"{d(2)} {d(4)} {d(3)}"])

    def many(low: int, high: int) -> str:
        return " ".join(d(r.randint(1, 4)) for _ in range(r.randint(low, high)))

    out = []
    for i in range(n):
        if i % 2:
            make = r.choice([card, card, phone, phone, local])
            values = [make() for _ in range(1 if make is local else r.choice([1, 1, 2]))]
            told = r.choice(["", "", {card: r.choice(["card", "visa", "pay with"]), phone: "tel:", local: "call"}[make]])
            near = [*values, *[beside() for _ in range(r.choice([0, 1, 1, 2]))]]
            text = " ".join(near if make is local or r.random() < 0.6 else r.sample(near, len(near)))
        else:
            values, told = [], r.choice(["scores", "years", "rows", "table", "order", "serial", "", ""])
            text = r.choice([many(5, 12), many(5, 12), f"+{many(5, 10)}", "-".join(d(r.randint(1, 5)) for _ in range(6)), f"{d(4)}/{d(2)}/{d(2)} {d(2)}.{d(2)}.{d(2)} {d(4)}"])
        out.append((f"{fill()} {told} {text} {fill()}", values))
    return out


def _fit_trees(spark: SparkSession, rows: list[dict], width: int, gens: range) -> tuple[gbt.Model, tuple[float, ...]]:
    """Trees over the first ``width`` features and the thresholds of ``gens``."""
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), "array<struct<t:string,y:int,n:int,v:array<string>>>")).alias("r"))
    table = table.select("r.t", "r.y", "r.n", "r.v")
    if gens.start == PARTS:
        table = table.withColumn("base", base_spans(F.col("t"), F.lit(True), False)).withColumn("blank", let(F.col("base"), lambda base: blanked(F.col("t"), base, False)))
    seen = candidates(F.col("blank" if gens.start == PARTS else "t"), F.lit(True), gens, False)
    found = table.select("t", "y", "n", "v", F.explode(seen).alias("c"))
    label = F.when(F.col("v").isNull(), F.col("y")).otherwise(F.array_contains("v", F.col("c.m")).cast("int"))
    x_of = F.array(*feature_columns(F.col("chunks"), F.col("c"))[:width])
    got = sorted((r["n"], r["x"][0], r["x"], r["y"]) for r in found.withColumn("chunks", _chunks(F.col("t"))).select("n", label.alias("y"), x_of.alias("x")).collect())
    x, y = np.array([g[2] for g in got]), np.array([g[3] for g in got], dtype=float)
    held = np.array([g[0] // 2 % 3 == 0 for g in got])
    model = gbt.fit(x[~held], y[~held], trees=30, depth=3, rate=0.3)
    scale = gbt.fit_isotonic(model.margin(x[held]), y[held])
    cuts = []
    for g in gens:
        mine = held & (x[:, 0] == g)
        p, t = scale(model.margin(x[mine])), y[mine]
        good = [c for c in LEVELS if (p >= c).any() and t[p >= c].mean() >= PRECISION]
        # the lowest calibrated score that has the precision asked for, as a margin
        cuts.append(float(np.interp(good[0], scale.value, scale.at)) if good else float("inf"))
    return model, tuple(cuts)


@lru_cache(maxsize=1)
def _fit_rows(session_id: str) -> tuple[tuple[gbt.Model, gbt.Model], tuple[float, ...]]:
    spark = SparkSession.active()
    rows = [{"t": t, "y": y, "n": i, "v": None} for i, (t, y) in enumerate(_examples(EXAMPLES))]
    parts = [{"t": t, "y": 0, "n": i, "v": v} for i, (t, v) in enumerate(_number_examples(EXAMPLES))]
    whole, cuts = _fit_trees(spark, rows, FEATURES.index("card_groups"), range(PARTS))
    part, more = _fit_trees(spark, parts, len(FEATURES), range(PARTS, len(GENERATORS)))
    return (whole, part), (*cuts, *more)


def fit(spark: SparkSession) -> tuple[tuple[gbt.Model, gbt.Model], tuple[float, ...]]:
    """Both kinds of trees and each generator's threshold; the same in every session, so kept for the
    process."""
    return _fit_rows(spark.version)


# --- the operator ---------------------------------------------------------------------------------


def _chosen(text: Column, proposed: Column, base: Column, models: tuple[gbt.Model, gbt.Model], cuts: tuple[float, ...]) -> Column:
    """Proposals above their threshold, best first, that meet neither a base span nor one kept before."""

    def margin(model: gbt.Model, x: Column) -> Column:
        return model.margin_column([F.get(x, F.lit(i)) for i in range(len(FEATURES))])

    def scored(chunks: Column) -> Column:
        def of(c: Column) -> Column:
            return let(
                F.array(*feature_columns(chunks, c)),
                lambda x: F.struct(
                    c["start"].alias("start"), c["end"].alias("end"), c["gen"].alias("gen"), c["kind"].alias("kind"),
                    (-F.when(c["gen"] < PARTS, margin(models[0], x)).otherwise(margin(models[1], x))).alias("loss"),
                ),
            )

        return F.filter(F.transform(proposed, of), lambda c: -c["loss"] >= F.get(F.array(*[F.lit(c) for c in cuts]), c["gen"]))

    def best(some: Column) -> Column:
        # between equal scores the first generator, then the longer span, then the earlier one
        ranked = F.array_sort(F.transform(some, lambda c: F.struct(c["loss"], c["gen"], (c["start"] - c["end"]).alias("short"), c["start"], c["kind"], c["end"])))
        none = F.array().cast("array<struct<start:int,kind:int,end:int,gen:int>>")

        def keep(kept: Column, c: Column) -> Column:
            span = F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["gen"].alias("gen"))
            return F.when(F.exists(kept, lambda k: (k["start"] < c["end"]) & (c["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(span)))

        return F.aggregate(ranked, none, keep)

    def clusters(spans: Column) -> Column:
        """Spans by start, cut where none reaches over: only within a part can any meet."""

        def of(ends: Column) -> Column:
            heads = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(ends, i - 1)))
            return let(heads, lambda h: F.flatten(F.transform(h, lambda at, k: best(F.slice(spans, at + 1, F.coalesce(F.get(h, k + 1), F.size(spans)) - at)))))

        return let(_running(F.transform(spans, lambda s: s["end"]), F.greatest), of)

    def settled(passed: Column) -> Column:
        kind = "array<struct<start:int,end:int,gen:int,kind:int,loss:double>>"
        fixed = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(-1).alias("gen"), s["kind"].alias("kind"), F.lit(float("-inf")).alias("loss")))
        every = F.array_sort(F.concat(passed.cast(kind), fixed.cast(kind)))
        kept = F.filter(let(every, clusters), lambda c: c["gen"] >= 0)
        return F.when(F.size(passed) > 0, F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))).otherwise(none)

    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(F.size(proposed) > 0, let(let(_chunks(text), scored), settled)).otherwise(none)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base, spans) of every row; spans have start, kind (place in ``KINDS``) and end."""
    models, cuts = fit(docs.sparkSession)

    text, blank = F.col("text"), F.col("blank")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # a step a column: one expression of all would nest deeper than the analyzer goes
    rows = rows.withColumn("numeric", text.rlike("[0-9]")).withColumn("base", base_spans(text, F.col("numeric")))
    rows = rows.withColumn("blank", let(F.col("base"), lambda base: blanked(text, base)))
    rows = rows.withColumn("proposed", candidates(blank, F.col("numeric")))
    added = let(F.col("base"), lambda base: let(F.col("proposed"), lambda proposed: _chosen(text, proposed, base, models, cuts)))
    return rows.select("doc_id", "text", "base", added.alias("added")).select("doc_id", "text", "base", F.array_sort(F.concat("base", "added")).alias("spans"))


def redact(found: DataFrame) -> DataFrame:
    """(doc_id, text) with each span replaced by its kind in brackets; overlapping spans as one."""
    names = F.array(*map(F.lit, KINDS))
    mark = lambda s, before: F.when(s["start"] >= before, F.concat(F.lit("["), F.get(names, s["kind"]), F.lit("]"))).otherwise("")
    return found.select("doc_id", let(F.col("spans"), lambda spans: _replaced(F.col("text"), spans, mark)).alias("text"))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
