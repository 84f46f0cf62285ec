"""What merged records look like, said of the rows they are made of.

A yardstick in its own terms: a record is the list of rows that joined it; its value is read off that list, and what
a row may join is read off the history of records and notes.
"""

import re
from dataclasses import dataclass, field

RESPONSE = ("ownerResponseText", "ownerResponseDate", "ownerResponseUpdatedAt")
OPTIONAL = ("reviewerProfilePhotoUrl", "updatedAt")


def plain(text):
    return re.sub(r"\s+", " ", (text or "").lower().replace("&", "and").replace("-", " ")).strip()


class Row(dict):
    @property
    def key(self):
        return self["branchId"] + "::" + self["id"]

    @property
    def google(self):
        return plain(self["reviewSource"]) == "google"

    @property
    def manual(self):
        return plain(self["reviewSource"]) == "manual update"

    @property
    def day_of_reviewer(self):
        return plain(self["branchId"]), plain(self["reviewerName"]), (self["publishedAt"] or "")[:10], int(self["rating"] or 0)

    @property
    def words(self):
        return (*self.day_of_reviewer, plain(self["comment"]))

    @property
    def date(self):
        return self["publishedAt"] or self["updatedAt"] or self["scrapedAt"] or ""


@dataclass
class Record:
    rows: list
    newest: bool

    def survivor(self):
        """The google row that counts, else the row that counts: the last one if the newest is kept, else the first."""
        pool = [r for r in self.rows if r.google] or self.rows
        return pool[-1 if self.newest else 0]

    def filled(self, name):
        """What a field ends with: values in the order of their weight, the heaviest first."""
        own = self.survivor()
        firsts = [i for i, r in enumerate(self.rows) if r.google]
        turn = firsts[0] if firsts else len(self.rows)
        if self.newest:
            weight = [r for r in reversed(self.rows) if r.google] + [r for r in reversed(self.rows[:turn])] + [r for r in self.rows[turn:] if not r.google]
        else:
            weight = [own, *self.rows]
        values = [r[name] for r in weight if (r[name] if name in RESPONSE else r[name] is not None)]
        return values[0] if values else own[name]

    def value(self):
        return Row(self.survivor()) | {name: self.filled(name) for name in RESPONSE + OPTIONAL}


@dataclass
class History:
    """All records of a merge, and the notes of which record stood last for which words or day."""

    newest: bool
    noted: bool
    records: list = field(default_factory=list)
    notes: list = field(default_factory=list)

    def last_noted(self, kind, what):
        return next((record for k, w, record in reversed(self.notes) if (k, w) == (kind, what)), None)

    @staticmethod
    def allowed(record, row):
        held = record.survivor()
        return (held.manual and row.google) or (held.google and row.manual)

    def home(self, row, incoming):
        by_key = [r for r in self.records if r.rows[0].key == row.key]
        if by_key:
            return by_key[0]
        if incoming and self.noted:
            same, near = self.last_noted("words", row.words), self.last_noted("day", row.day_of_reviewer)
            return same or (near if near and self.allowed(near, row) else None)
        alike = (r for r in self.records if r.survivor().words == row.words or (r.survivor().day_of_reviewer == row.day_of_reviewer and self.allowed(r, row)))
        return next(alike, None)

    def add(self, row, incoming):
        row = Row(row)
        record = self.home(row, incoming)
        opened = record is None
        if opened:
            record = Record([row], self.newest)
            self.records.append(record)
        else:
            record.rows.append(row)
        if opened or incoming:
            self.notes += [("words", row.words, record), ("day", row.day_of_reviewer, record)]


def merged(stored, incoming, newest, noted):
    history = History(newest, noted)
    for row in stored:
        history.add(row, False)
    for row in incoming:
        history.add(row, True)
    return [record.value() for record in history.records]


def listing(records):
    """As a dataset lists them: newest first, rows of one date as they are."""
    return sorted(records, key=lambda r: Row(r).date, reverse=True)
