"""Recognizers as data: what a number or handle looks like, how sure its shape is, what checks it, what words support it."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Recognizer:
    entity: str
    name: str
    patterns: tuple[tuple[str, float], ...]
    context: tuple[str, ...] = ()
    check: str | None = None  # luhn, verhoeff, octets or gstin
    length: int | None = None  # of the digits that the check takes


# Payment handles known by name.
UPI_HANDLES = "okhdfcbank|okicici|oksbi|okaxis|ybl|ibl|axl|apl|paytm|upi|airtel|freecharge|jupiteraxis|fam|slc|naviaxis|timecosmos"

# Formats, base scores and context words.
RECOGNIZERS = (
    Recognizer("IN_IFSC", "ifsc", ((r"\b[A-Z]{4}0[A-Z0-9]{6}\b", 0.7),), ("ifsc", "bank", "branch", "neft", "rtgs")),
    Recognizer("IN_DRIVING_LICENCE", "driving_licence", ((r"\b[A-Z]{2,4}[-\s]?\d{0,3}[-\s]?(?:19|20)\d{2}[-\s]?\d{6,7}\b", 0.5),), ("driving", "licence", "license", "dl no", "transport", "rto")),
    Recognizer("IN_ABHA", "abha_strict", ((r"\b\d{2}-\d{4}-\d{4}-\d{4}\b", 0.7), (r"\b\d{14}\b", 0.5)), ("abha", "abdm", "health", "ayushman", "phr"), "luhn", 14),
    Recognizer("IN_ABHA", "abha_fallback", ((r"\b\d{2}[\s-]\d{4}[\s-]\d{4}[\s-]\d{4}\b", 0.35), (r"\b\d{14}\b", 0.1)), ("abha", "abdm", "health", "ayushman", "phr")),
    Recognizer("IN_AADHAAR_VID", "vid_verhoeff", ((r"\b\d{4}[\s-]\d{4}[\s-]\d{4}[\s-]\d{4}\b", 0.6), (r"\b\d{16}\b", 0.4)), ("vid", "virtual", "aadhaar", "uidai"), "verhoeff", 16),
    Recognizer("IN_AADHAAR_MASKED", "masked_id", ((r"(?<![\w*])[Xx*]{4}[\s-]?[Xx*]{4}[\s-]?\d{4}\b", 0.6),), ("aadhaar", "aadhar", "uid", "uidai")),
    Recognizer("IN_ABHA_ADDRESS", "abha_address", ((r"\b[A-Za-z0-9](?:[A-Za-z0-9._-]{1,48})@(?:abdm|sbx)\b", 0.7),), ("abha", "abdm", "health", "phr")),
    Recognizer("IN_UPI_VPA", "upi", ((rf"\b[A-Za-z0-9](?:[A-Za-z0-9._-]{{1,48}})@(?:{UPI_HANDLES})\b", 0.7), (r"\b[A-Za-z0-9](?:[A-Za-z0-9._-]{2,48})@[A-Za-z][A-Za-z0-9]{1,19}\b", 0.35)), ("upi", "vpa", "pay", "payment", "paid", "transfer", "gpay", "phonepe")),
    Recognizer("IN_VEHICLE_REGISTRATION", "vehicle", ((r"\b[A-Z]{2}[\s-]?\d{1,2}[\s-]?[A-Z]{0,3}[\s-]?\d{4}\b", 0.4), (r"\b\d{2}[\s-]?BH[\s-]?\d{4}[\s-]?[A-HJ-NP-Z]{1,2}\b", 0.7)), ("vehicle", "registration", "reg no", "rto", "chassis", "engine", "car", "motor", "number plate")),
    Recognizer("IN_AADHAAR", "aadhaar_tolerant", ((r"\b[0-9]{4}[- :][0-9]{4}[- :][0-9]{4}\b", 0.5), (r"\b[0-9]{12}\b", 0.2)), ("aadhaar", "aadhar", "uidai", "uid")),
    Recognizer("IN_AADHAAR", "aadhaar_strict", ((r"\b[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}\b", 0.5),), ("aadhaar", "aadhar", "uidai", "uid"), "verhoeff", 12),
    Recognizer("IN_PAN", "pan", ((r"\b[A-Z]{3}[ABCFGHJLPT][A-Z]\d{4}[A-Z]\b", 0.6), (r"\b[A-Z]{5}\d{4}[A-Z]\b", 0.3)), ("pan", "permanent", "income", "tax")),
    Recognizer("IN_VOTER", "voter", ((r"\b[A-Z]{3}\d{7}\b", 0.4),), ("voter", "epic", "election")),
    Recognizer("IN_PASSPORT", "passport", ((r"\b[A-PR-WY][1-9]\d\s?\d{4}[1-9]\b", 0.3),), ("passport", "travel")),
    Recognizer("IN_GSTIN", "gstin", ((r"\b\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b", 0.7),), ("gst", "gstin", "tax"), "gstin"),
    Recognizer("EMAIL_ADDRESS", "email", ((r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b", 0.7),), ("email", "mail")),
    Recognizer("IP_ADDRESS", "ip", ((r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0.6),), ("ip", "address", "host"), "octets"),
    Recognizer("CREDIT_CARD", "card", ((r"\b\d{13,19}\b", 0.4), (r"\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}\b", 0.5)), ("card", "credit", "visa"), "luhn"),
    Recognizer("PHONE_NUMBER", "phone", ((r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}\b", 0.5), (r"\(\d{3}\) \d{3}-\d{4}\b", 0.4)), ("phone", "mobile", "call", "tel")),
    Recognizer("US_PASSPORT", "us_passport", ((r"\b[A-Z]?\d{9}\b", 0.05),), ("passport", "travel")),
    Recognizer("DATE_TIME", "date", ((r"\b\d{4}-\d{2}-\d{2}\b", 0.6), (r"\b\d{1,2}/\d{1,2}/\d{4}\b", 0.6)), ()),
)

# Boost of a context word, words before a span in which it is sought, least score, what is left out unless asked for.
CONTEXT_BOOST, CONTEXT_WORDS, THRESHOLD, EXCLUDED = 0.35, 5, 0.4, ("DATE_TIME",)


def named(*names: str) -> tuple[Recognizer, ...]:
    return tuple(r for r in RECOGNIZERS if r.name in names)


def registry(strict_aadhaar: bool = False, more: tuple[Recognizer, ...] = ()) -> tuple[Recognizer, ...]:
    """All recognizers and further ones; strict leaves out the tolerant form of Aadhaar numbers, which has no check."""
    return tuple(r for r in RECOGNIZERS if not (strict_aadhaar and r.name == "aadhaar_tolerant")) + tuple(more)


def entities(wanted: list[str] | None = None, dates: bool = False) -> list[str]:
    """An explicit list, or else all that is supported without what is excluded."""
    return list(wanted) if wanted else sorted({r.entity for r in RECOGNIZERS} - (set() if dates else set(EXCLUDED)))
