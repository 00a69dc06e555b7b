"""Which cell of a stop is read next, and what all its readings together say.

The decision is written once, as a generator that asks for readings when it needs them.  Run with the readings
known so far it either stops at the first that is missing, which is then asked for, or comes to a result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Generator, Mapping
from dataclasses import dataclass, replace

from . import delivery as D

#: Kind of cell, variant, and lines up (-1) or none (0).
Key = tuple[str, int, int]


@dataclass(frozen=True)
class Reading:
    """What one look at a cell gave; ``lone``: a number without a pair stands where the delivered one does, and no other row is there."""

    text: str = ""
    confidence: float | None = None
    lone: bool = False

    @property
    def label(self) -> D.Label:
        return D.parse_label(self.text)

    def pair(self) -> Reading | None:
        """The only line that shows a pair, if there is just one."""
        lines = [" ".join(x.split()) for x in re.split(r"\n+", self.text)]
        found = [x for x in lines if D.pair_in(x) and D.number_of(x) is not None]
        return replace(self, text=found[0]) if len(found) == 1 else None


@dataclass(frozen=True)
class PageReading:
    """What the page itself shows of a stop's delivery; ``earlier`` is the same of a reading before parts were read again."""

    label: str = ""
    number: str | None = None
    number_text: str = ""
    confidence: float = 0.0
    companions: tuple[str, ...] = ()
    earlier: PageReading | None = None

    def votes(self) -> list[D.Vote]:
        own = [] if self.number is None else [D.Vote(self.number, self.confidence, D.pair_in(self.number_text))]
        before = self.earlier
        if before is not None and before.number is not None and D.parse_label(before.label).kind == "collection":
            own.append(D.Vote(before.number, before.confidence, D.pair_in(before.number_text)))
        return own

    def all_companions(self) -> tuple[str, ...]:
        return self.companions + (self.earlier.companions if self.earlier else ())

    def surely_parcel(self) -> bool:
        return D.parse_label(self.label).kind == "parcel"


@dataclass(frozen=True)
class Result:
    delivery_type: str
    delivery_review: str
    delivery_source: str


Asking = Generator[list[Key], list[Reading], Result]


def _label(page: PageReading) -> Generator[list[Key], list[Reading], tuple[Reading, int, PageReading]]:
    """The label's reading, the line it is on, and the page's reading as far as it still counts."""
    (label,) = yield [("label", 0, 0)]
    shift = 0
    if "Behältemappe" in D.canonical_label(label.text):  # a companion's line: what is delivered stands above it
        tried = yield [("label", 0, -1)]
        if tried[0].label.kind == "other":
            tried = tried + (yield [("label", 1, -1)])
        above = next((r for r in tried if r.label.kind != "other"), None)
        if above is not None:
            label, shift, page = above, -1, replace(page, label="", number=None, number_text="", confidence=0.0)
    if label.label.kind == "other" and D.parse_label(page.label).kind == "other":
        (along,) = yield [("label", 1, shift)]
        if along.label.kind != "other" or (along.label.title and (along.confidence or 0) > (label.confidence or 0)):
            label = along
    return label, shift, page


def _confirmed(found: Reading, again: Reading) -> bool:
    """Whether a second look agrees with an uncertain pair; also by the same digits without the slash, which never make a new number."""
    value = D.number_of(found.text) or ""
    if (second := again.pair()) is not None:
        return D.number_of(second.text) == value
    digits = re.sub(r"\D", "", again.text)
    return bool(re.fullmatch(r"\d{3,4}", digits)) and digits.startswith(value) and len(digits) - len(value) <= 2


def _numbers(shift: int) -> Generator[list[Key], list[Reading], list[tuple[Reading, bool]]]:
    """The readings of the number that count, each with whether it is known to be of a pair."""
    plain = yield [("number", 0, shift), ("number", 1, shift)]
    if any(D.pair_in(r.text) for r in plain):
        return [(r, False) for r in plain]
    (along,) = yield [("number", 3, shift)]
    found = along.pair()
    if found is None:
        (tall,) = yield [("number", 2, shift)]
        found = tall.pair()
        if found is None:
            alone = tall.lone and all(D.number_of(r.text) is None for r in plain)
            return [(r, False) for r in (*plain, *([tall] if alone else []))]
    if found.confidence is not None and found.confidence >= D.SURE_CONFIDENCE:
        return [(found, False)]
    (again,) = yield [("number", 4, shift)]
    vote = Reading(D.number_of(found.text) or "", max(again.confidence or 0, D.SURE_CONFIDENCE))
    return [(found, False), *([(vote, True)] if _confirmed(found, again) else [])]


def decide(page: PageReading) -> Asking:
    """Type, review and source of a stop, asking for one round of readings after another."""
    if page.surely_parcel():
        return Result(*D.fuse_evidence(page.label, page.confidence, "", 0, page.votes(), page.all_companions()), " | ".join(x for x in (page.label, page.number_text) if x))
    label, shift, page = yield from _label(page)
    seen = (label.label, D.parse_label(page.label))
    numbers: list[tuple[Reading, bool]] = []
    if any(x.kind == "collection" for x in seen) and not any(x.wish for x in seen):
        numbers = yield from _numbers(shift)
    votes = page.votes()
    votes += [D.Vote(v, r.confidence, pair or D.pair_in(r.text)) for r, pair in numbers if (v := D.number_of(r.text)) is not None]
    text = " ".join(label.text.split())
    shown = next((t for r, _ in numbers if (t := " ".join(r.text.split()))), page.number_text)
    kind, review = D.fuse_evidence(page.label, page.confidence, text, label.confidence or 0, votes, page.all_companions())
    return Result(kind, review, " | ".join(x for x in (text or page.label, shown) if x))


def resume(asking: Asking, known: Mapping[Key, Reading]) -> Result | list[Key]:
    """Run until a reading is missing, which is returned with the others asked together, or to the result; a ``defaultdict`` lacks none."""
    try:
        wanted = next(asking)
        while True:
            if missing := [k for k in wanted if k not in known and not isinstance(known, defaultdict)]:
                return missing
            wanted = asking.send([known[k] for k in wanted])
    except StopIteration as done:
        return done.value
