"""Person names by capitalization: runs of capitalized words and initials, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bound
from .patterns import pieces, placed

# Capitalized words that are not names.
STOP_WORDS = (
    "I", "The", "A", "An", "This", "That", "These", "Those", "My", "Your", "His", "Her", "Its", "Our", "Their",
    "We", "They", "He", "She", "It", "Is", "Are", "Was", "Were", "Be", "Been", "Being", "Have", "Has", "Had", "Do",
    "Does", "Did", "Will", "Would", "Could", "Should", "May", "Might", "Can", "Must", "Shall", "To", "Of", "In",
    "For", "On", "With", "At", "By", "From", "As", "But", "Or", "And", "Not", "No", "So", "If", "Also", "CC",
    "Send", "Please", "Forward", "Call", "Server", "Key", "Contact", "Email", "Phone", "IP", "SSN", "CPF",
    "Already", "Confirmed", "Meeting", "Tomorrow", "Invoice", "Report", "Thread", "Said",
)

# A capitalized word, or an initial with its point and the white space after it; the widest gap inside
# one name.
WORD_OR_INITIAL = r"\b[A-Z][a-z]+\b|\b[A-Z]\.\s*"
WIDEST_GAP = 2

NAME = "struct<text:string,start:int,end:int>"


def name_spans(text: str | Column) -> Column:
    """array<NAME>: neighbouring parts at most WIDEST_GAP characters apart are one name. A part opens a name or ends one
    by its distance to its neighbours; the name's text is put together from the pieces of the text."""
    text = F.col(text) if isinstance(text, str) else text

    def islands(all_: Column) -> Column:
        parts = F.filter(F.transform(all_, lambda p, k: F.struct(p["text"].alias("text"), p["start"].alias("start"), p["end"].alias("end"), k.alias("at"))), lambda p: (p["at"] % 2 == 1) & ~p["text"].isin(*STOP_WORDS))

        def joined(parts: Column) -> Column:
            apart = lambda a, b: F.coalesce(b["start"] - a["end"] > WIDEST_GAP, F.lit(True))
            opening = F.filter(parts, lambda p, k: apart(F.get(parts, k - 1), p))
            closing = F.filter(parts, lambda p, k: apart(p, F.get(parts, k + 1)))
            words = lambda a, b: F.array_join(F.transform(F.slice(all_, a["at"] + 1, b["at"] - a["at"] + 1), lambda p: p["text"]), "")
            return F.zip_with(opening, closing, lambda a, b: F.struct(words(a, b).alias("text"), a["start"].alias("start"), b["end"].alias("end")))

        return bound(parts, joined)

    named = bound(bound(pieces(text, WORD_OR_INITIAL), placed), islands)
    return F.coalesce(named, F.array().cast(f"array<{NAME}>"))
