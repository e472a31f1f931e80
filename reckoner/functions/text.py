"""Reading references and payers out of bank narrations, and folding names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may be a reference, what a stem leaves out as one, and a stem's words.
REFERENCE_SHAPE, LEFT_OUT_SHAPE, STEM_WORD = "[A-Z0-9]{12,22}", "[A-Z0-9]{10,22}", "[A-Z]{3,}"
#: Words that look like a reference and are none.
REFERENCE_NOISE = ("RAZORPAY", "RAZORPAYSOFTWARE", "SETTLEMENT", "PAYOUT", "INWARD", "SOFTWARE")
#: Bank words taken out before a damaged reference is compared.
BANK_WORDS = ("RAZORPAY", "SOFTWARE", "SETTLEMENT", "PAYOUT", "INWARD", "NEFT", "IMPS", "UTR", "ACH", "PVT", "LTD", "CR")
#: Payment rails and joining words, which are never the payer.
RAILS = ("NEFT", "RTGS", "IMPS", "UPI", "ACH", "NACH", "ECS", "CR", "DR", "TRF", "FROM", "REF", "TO", "BY")
#: Words that say a deposit is a gateway payout.
GATEWAY_WORDS = ("RAZORPAY", "RZPY", "SETTLEMENT", "SETTLEMENTS", "PAYOUT", "PAYOUTS")


def normalise_name(text: Column) -> Column:
    """Lower case, each run of other characters than letters and digits one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def extract_reference(narration: Column) -> Column:
    """The first run of 12 to 22 capitals and digits that is no bank word and not all letters."""
    found = F.regexp_extract_all(F.upper(narration), F.lit(rf"\b({REFERENCE_SHAPE})\b"), 1)
    return F.get(F.filter(found, lambda x: ~x.isin(*REFERENCE_NOISE) & x.rlike("[0-9]")), F.lit(0))


def reference_letters(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def narration_letters(narration: Column) -> Column:
    """The characters that a reference could be made of, bank words gone."""
    return F.regexp_replace(F.regexp_replace(F.upper(narration), rf"\b(?:{'|'.join(BANK_WORDS)})\b", " "), "[^A-Z0-9]", "")


def payer_stem(narration: Column) -> Column:
    """The first four words of three letters or more once references and rails are gone."""
    plain = F.regexp_replace(F.upper(narration), rf"\b{LEFT_OUT_SHAPE}\b", " ")
    plain = F.regexp_replace(plain, rf"\b(?:{'|'.join(RAILS)})\b", " ")
    return F.array_join(F.slice(F.regexp_extract_all(plain, F.lit(STEM_WORD), 0), 1, 4), " ")
