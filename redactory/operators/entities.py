"""Entities by pattern and dictionary, and context patterns and scores."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactory.functions.spans import PIECE, bound, exploded, screened, spans, window as cut_out
from redactory.operators.termtable import lowered


class Entity(NamedTuple):
    op: str
    type: str
    confidence: float
    regex: str
    ignore_case: bool = False
    #: What must follow a match, as a pattern without groups; it is not part of the span.
    until: str = ""

    def java(self) -> str:
        return self.regex + (f"(?={self.until})" if self.until else "")

    def whole(self) -> str:
        """The same with what must follow as part of the match, for screens."""
        return self.regex + (f"(?:{self.until})" if self.until else "")


_DAY = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_STREET = "Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Boulevard|Blvd|Court|Ct|Place|Pl|Way|Circle|Cir|Loop|Trail|Terrace|Ter|Parkway|Pkwy"
_TLD = "com|org|net|edu|gov|io|co|us|uk|ca|au|de|fr|info|biz|me"
_NUMBER = "zero|one|two|three|four|five|six|seven|eight|nine|oh|nought|aught"
_TITLE = "Dr|Mr|Mrs|Ms|Miss|Prof|Professor|Rev|Reverend|Capt|Captain|Sgt|Sergeant|Lt|Col|Gen|Maj|Adm|Cmdr|Cpl|Pvt|Insp|Det|Atty|Hon|Sheikh|Imam|Rabbi|Fr|Br|Sr|Deacon|Chancellor|Ambassador"
_ORG = r"Inc\.|Corp\.|LLC|Ltd\.|L\.L\.C\.|L\.P\.|Foundation|University|Hospital|Bank|Group|Partners|Associates|Institute|Center|Centre|Agency|Authority|Commission|Laboratory|Laboratories|Labs|Technologies|Systems|Solutions|Services|Consulting|Capital|Ventures|Management|Holdings|Academy|School|College|Clinic|Medical|Church|Ministry|Department|Bureau|Division|Press|Publishing|Media|Network|Alliance|Federation|Union|Council|Society|Association"
_COUNT = "one|two|three|four|five|six|seven|eight|nine|ten"

# Entity patterns and confidences, in the order in which an earlier one wins.
# Group repeats have upper bounds, so that no text can exhaust the matcher's stack.
PERSON = [Entity("ner_person_title", "person", 0.93, rf"\m(?:(?:{_TITLE})\.?\s+){{1,4}}[A-Z][a-zA-Z'-]+(?:\s+[A-Z][a-zA-Z'-]+){{0,4}}(?:\s+(?:Jr|Sr|II|III|IV|V|Esq|PhD|MD|DO|JD|MBA|CPA|RN|NP|PA)\.?)?")]
ORGANIZATION = [Entity("ner_org_suffix", "organization", 0.87, rf"\m[A-Z][a-zA-Z&'-]+(?:\s+(?:&\s+)?[A-Z][a-zA-Z&'-]+){{0,7}}\s+(?:{_ORG})\b")]
DATES = [
    Entity("ner_date", "date", 0.82, rf"\m(?:next|last|this|coming|upcoming|following|previous|past)\s+(?:{_DAY}|week|month|year|quarter|weekend|season)\b", True),
    Entity("ner_date", "date", 0.78, rf"\m(?:in|by|before|after|around|during|throughout|since|until|from|through)\s+(?:{_MONTH})\b", True),
    Entity("ner_date", "date", 0.88, rf"\m(?:{_MONTH})\s+(?:\d{{1,2}}(?:st|nd|rd|th)?,?\s+)?\d{{4}}\b", True),
    Entity("ner_date", "date", 0.88, rf"\mthe\s+\d{{1,2}}(?:st|nd|rd|th)\s+of\s+(?:{_MONTH})\b", True),
    Entity("ner_date", "date", 0.90, r"\mQ[1-4]\s+(?:FY\s*)?\d{4}\b", True),
    Entity("ner_date", "date", 0.82, rf"\m(?:\d+|{_COUNT}|several|a few|a couple of)\s+(?:days?|weeks?|months?|years?|quarters?)\s+(?:ago|from now|later|hence|prior|earlier)\b", True),
    Entity("ner_date", "date", 0.78, rf"\m(?:in|within|over the next|over the past)\s+(?:\d+|{_COUNT})\s+(?:days?|weeks?|months?|years?|quarters?)\b", True),
    Entity("ner_date", "date", 0.80, rf"\m(?:early|mid|late|mid-|early-|late-)\s*(?:{_MONTH})\b", True),
    Entity("ner_date", "date", 0.85, r"\m(?:first|second|third|fourth)\s+(?:quarter|half)\s+of\s+\d{4}\b", True),
    Entity("ner_date", "date", 0.85, r"\m(?:fiscal\s+year\s+|FY\s*)\d{4}\b", True),
]
# Phrases end, at the earliest, before a sign, two spaces or the text's end.
_ENDS = r"[,.\n!?]|\z|\s\s"
_PHRASE = r"[a-zA-Z][a-zA-Z\s]{2,40}?"
MEDICAL = [
    Entity("ner_medical_phrase", "medical", 0.92, rf"\m(?:diagnosed\s+with|diagnosis\s+of)\s+{_PHRASE}", True, _ENDS),
    Entity("ner_medical_phrase", "medical", 0.90, r"\m(?:prescribed|taking|takes|was\s+given)\s+[a-zA-Z][a-zA-Z\s]{2,30}?", True, r"[,.\n!?;]|\z|\s\s"),
    Entity("ner_medical_phrase", "medical", 0.88, rf"\m(?:suffering\s+from|history\s+of|presenting\s+with|symptoms?\s+of|complaints?\s+of)\s+{_PHRASE}", True, _ENDS),
    Entity("ner_medical_phrase", "medical", 0.88, rf"\m(?:treatment\s+for|treated\s+for|therapy\s+for|medication\s+for|drugs?\s+for)\s+{_PHRASE}", True, _ENDS),
    Entity("ner_medical_phrase", "medical", 0.88, rf"\mpatient\s+(?:has|had|with|presents?\s+with|is\s+a\s+\d+-year)\s+{_PHRASE}", True, _ENDS),
    Entity("ner_medical_phrase", "medical", 0.85, rf"\m(?:recovering\s+from|underwent|underwent\s+a|received)\s+{_PHRASE}", True, _ENDS),
    Entity("ner_medical_phrase", "medical", 0.90, r"\mstage\s+(?:[0-9]+|[IVXivx]+)\s+[a-zA-Z][a-zA-Z\s]{2,30}?\b", True),
]
ADDRESSES = [
    Entity("ner_address", "address", 0.85, rf"\m(?:lives?\s+(?:at|on|near)|office\s+at|located\s+at|based\s+at|address\s+(?:is\s+)?(?:at\s+)?|mailing\s+address\s+(?:is\s+)?|resides?\s+(?:at|on)|headquartered\s+at|situated\s+at|found\s+at|meet\s+(?:me\s+)?at)\s+(?:\d+\s+)?[A-Z][a-zA-Z\s]{{1,60}}(?:{_STREET})\M", True),
    Entity("ner_address", "address", 0.72, r"\m(?:Suite|Ste|Floor|Fl|Building|Bldg|Unit|Apt|Room|Rm)\s+[A-Z0-9]+\b", True),
    Entity("ner_address", "address", 0.75, rf"\m\d{{1,5}}\s+[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)?\s+(?:{_STREET})\b"),
    Entity("ner_address", "address", 0.88, r"\mP\.?\s*O\.?\s*Box\s+\d+\b", True),
    Entity("ner_address", "address", 0.82, r"\m[A-Z][a-zA-Z]+(?: [A-Z][a-zA-Z]+){0,4},\s+[A-Z]{2}\s+\d{5}(?:-\d{4})?\b"),
]
PHONES = [
    Entity("ner_phone_spoken", "phone_conversational", 0.85, rf"\m(?:call\s+(?:me\s+)?(?:at|on)|reach\s+(?:me\s+)?(?:at|on)|my\s+(?:phone|cell|mobile|number)\s+(?:number\s+)?(?:is|was)|phone\s+(?:number\s+)?(?:is|was)|contact\s+(?:me\s+)?(?:at|on)\s+)\s*(?:(?:{_NUMBER})[\s,]+){{6,12}}(?:{_NUMBER})", True),
    Entity("ner_phone_spoken", "phone_conversational", 0.80, r"\m(?:call\s+(?:me\s+)?(?:at|on)|reach\s+(?:me\s+)?(?:at|on)|my\s+(?:phone|cell|mobile|number)\s+(?:number\s+)?(?:is|was))\s+\d[\d\s\-().]{6,18}\d", True),
    Entity("ner_phone_spoken", "phone_conversational", 0.70, rf"\m(?:(?:{_NUMBER})[,\s]+){{6,10}}(?:{_NUMBER})\b", True),
]
EMAILS = [
    Entity("ner_email_obfuscated", "email_obfuscated", 0.87, rf"\m[a-zA-Z0-9][a-zA-Z0-9._+'-]*(?:\s+dot\s+[a-zA-Z0-9._+'-]+)?\s+(?:at|@)\s+[a-zA-Z0-9][a-zA-Z0-9.-]*\s+dot\s+(?:{_TLD})\b", True),
    Entity("ner_email_obfuscated", "email_obfuscated", 0.80, r"\m(?:[a-zA-Z]\s+){3,64}(?:@|at)\s+(?:[a-zA-Z]\s*){2,64}(?:\.|dot)\s*(?:com|org|net|io|edu|gov)\b", True),
    Entity("ner_email_obfuscated", "email_obfuscated", 0.88, rf"\m(?:email|e-mail|contact|reach|message|write)\s+(?:(?:me|us)\s+)?(?:at|@)\s+[a-zA-Z0-9][a-zA-Z0-9._+'-]*\s+(?:at|@)\s+[a-zA-Z0-9][a-zA-Z0-9.-]*\s+dot\s+(?:{_TLD})\b", True),
]
FAMILIES = {"ner_person_title": PERSON, "ner_org_suffix": ORGANIZATION, "ner_date": DATES, "ner_medical_phrase": MEDICAL, "ner_address": ADDRESSES, "ner_phone_spoken": PHONES, "ner_email_obfuscated": EMAILS}

# Context keywords by the type of a span that they support, or speak against.
BOOST_WORDS = {
    "financial": ["salary", "compensation", "comp", "annual", "base pay", "bonus", "equity", "rsu", "stock option", "income", "wages", "earnings", "take-home", "gross pay", "net pay", "w-2", "w2", "1099", "tax bracket", "total comp", "tc is", "my tc", "offer letter", "pay stub", "payroll", "pay rate", "hourly rate", "per year", "per annum", "k a year", "k per year", "annually", "biweekly", "direct deposit", "severance", "golden parachute", "signing bonus", "retention bonus", "vesting", "strike price", "exercise price", "ote", "on-target earnings", "i make", "i earn", "they offered", "package is", "package was", "raise to", "promoted to", "new role pays", "current comp"],
    "medical_record": ["diagnosed", "prescribed", "patient", "symptoms", "treatment", "surgery", "condition", "chronic", "acute", "prognosis", "lab results", "vitals", "medication", "dosage", "mg", "twice daily", "once daily", "medical record", "mrn", "chart", "clinical", "pathology", "biopsy", "radiology", "oncology", "referral", "discharge", "admission", "emergency room", "icu", "nicu", "hospice", "therapist", "psychiatrist", "counselor", "diagnosis code", "icd-", "cpt-", "hipaa", "phi", "protected health", "blood pressure", "heart rate", "bmi", "glucose", "cholesterol", "hemoglobin", "white blood cell", "platelet", "creatinine"],
    "legal_amount": ["settlement", "plaintiff", "defendant", "confidential", "privileged", "attorney-client", "under seal", "nda", "non-disclosure", "litigation", "arbitration", "mediation", "damages", "liability", "indemnification", "breach", "clause", "stipulation", "deposition", "discovery", "subpoena", "court order", "judgment", "verdict"],
    "person_name": ["patient", "client", "employee", "applicant", "candidate", "resident", "beneficiary", "dependent", "spouse", "minor", "subscriber", "policyholder", "account holder", "cardholder", "user", "member", "contact", "next of kin", "guardian", "emergency contact", "primary care", "referred by", "ssn", "date of birth", "dob", "social security", "passport", "license"],
    "address": ["lives at", "resides at", "home address", "mailing address", "shipping address", "billing address", "residence", "apartment", "suite", "unit", "floor", "zip code", "postal code", "zip", "deliver to", "ship to", "send to", "located at", "office at", "street address", "physical address"],
    "identity_document": ["passport", "passport number", "driver license", "drivers license", "license number", "dl number", "state id", "national id", "government id", "identity card", "id number", "document number", "issued by", "expiration date", "date of issue", "country of issue", "travel document", "visa number", "green card", "work permit"],
}
SUPPRESS_WORDS = {
    "financial": ["product price", "costs", "revenue", "market cap", "stock price", "fundraise", "raised", "investment round", "list price", "msrp", "retail price", "wholesale", "budget", "forecast", "projection", "quarterly revenue", "annual revenue", "total revenue", "operating cost", "overhead", "price tag", "discount", "coupon", "valuation", "series a", "series b", "seed round", "ipo", "market value", "enterprise value", "gdp", "inflation"],
    "person_name": ["character", "fictional", "protagonist", "antagonist", "author", "wrote", "novel", "movie", "film", "tv show", "series", "played by", "starring", "directed by", "produced by", "example", "placeholder", "test data", "sample", "demo"],
    "medical_record": ["in the show", "fictional", "character", "plot", "storyline", "article about", "research on", "study finds", "according to", "wikipedia", "webmd", "general information"],
}


def keyword_rows() -> list[tuple[str, str, str]]:
    """The same as rows (type, keyword, side)."""
    return [(t, k, side) for side, by in (("boost", BOOST_WORDS), ("suppress", SUPPRESS_WORDS)) for t, words in by.items() for k in words]


#: Dictionaries are tables (operators/lexicons.py); these short samples are always part of the registered ones.
DICTIONARIES = {
    "ner_org_dict": ("organization", 0.89, ["Goldman Sachs", "World Bank", "Microsoft", "Stanford", "Memorial"]),
    "ner_drug": ("medical", 0.80, ["metformin", "aspirin", "insulin", "ibuprofen", "lisinopril"]),
    "ner_condition": ("medical", 0.88, ["lymphoma", "asthma", "diabetes", "hypertension"]),
    "ner_procedure": ("medical", 0.76, ["MRI", "biopsy", "colonoscopy", "CT scan"]),
}
FIRST_NAMES = ["Sarah", "Carlos", "Priya", "James", "Mary"]
LAST_NAMES = ["Chen", "Rodriguez", "Patel", "Smith", "Jones"]
STOP_WORDS = ["The", "Call", "Card", "Box", "Oak", "New", "York", "Then", "Street", "Bank", "Group"]
BIGRAM = r"\b[A-Z][a-zA-Z'-]+\s+[A-Z][a-zA-Z'-]+\b"
CAPS = r"\b[A-Z][a-z]{1,19}(?:[-'][A-Za-z]+)?(?:\s+[A-Z][a-z]{1,19}(?:[-'][A-Za-z]+)?){1,3}\b"
#: Words that make a condition near them certain.
MEDICAL_WORDS = "patient|diagnosed|prescribed|doctor|physician|hospital|clinic|treatment|symptoms?|chronic|acute|severe|mild|stage|medical|health|disease|disorder|condition|medication|drug|therapy|surgery|nurse|record"


def dictionary_regex(terms: list[str]) -> str:
    """All terms between word borders, the longest first."""
    return r"\b(?:" + "|".join(t.replace(" ", r"\s").replace(".", r"\.") for t in sorted(terms, key=lambda t: (-len(t), t))) + r")\b"


def entity_spans(text: Column, family: list[Entity]) -> Column:
    """Spans of a family, with the pattern's place as ord; overlaps are left to first_writer_wins."""
    held = screened(text, [(e.whole(), e.ignore_case) for e in family])

    def tagged(i: int, e: Entity) -> Column:
        return F.transform(spans(text, e.java(), e.ignore_case, held=F.array_contains(held, i)), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(e.type).alias("type"), F.lit("ner").alias("source"), F.lit(e.confidence).alias("confidence"), F.lit(i).alias("ord")))

    return F.concat(*(tagged(i, e) for i, e in enumerate(family)))


class Context(NamedTuple):
    op: str
    type: str
    confidence: float
    window: int
    regex: str
    keywords: tuple[str, ...]
    #: What must follow a match, as for entities.
    until: str = ""

    java, whole = Entity.java, Entity.whole


# Context patterns with their keywords, window and confidence.
CONTEXTS = [
    Context("ctx_salary", "financial", 0.85, 120, r"\$?\d{2,3}[,.]?\d{0,3}\s*[kK]\b|\$\d{1,3}(?:,\d{3})+|\$\d{4,}", ("salary", "compensation", "comp", "make", "earn", "offer", "package", "tc", "total comp", "base", "pay", "income", "annually", "per year", "a year", "raise", "promoted")),
    Context("ctx_medical_phrase", "medical_record", 0.90, 200, r"(?i:diagnosed with|suffers from|treated for|presenting with|history of|positive for|tested positive for|confirmed case of)\s+[\w\s]{3,50}", ("patient", "medical", "clinical", "hospital", "doctor", "physician", "nurse", "chart", "record", "treatment"), r"[.,;\n]|\z"),
    Context("ctx_legal_amount", "financial", 0.88, 150, r"\$\d[\d,.]*\s*(?:million|billion|[mMbB]\b)", ("settlement", "awarded", "damages", "judgment", "verdict", "plaintiff", "defendant", "lawsuit", "litigation", "court", "confidential", "sealed", "nda")),
    Context("ctx_ip", "ip_address", 0.82, 100, r"\m(?:\d{1,3}\.){3}\d{1,3}\b", ("server", "internal", "vpn", "firewall", "ssh", "database", "production", "staging", "private", "intranet", "network", "connect to", "host", "endpoint", "api server")),
    Context("ctx_titled_name", "person_name", 0.90, 200, r"\m(?:Dr|Mr|Mrs|Ms|Prof|Rev|Sr|Jr)\.?\s+[A-Z][a-z]{1,20}(?:\s+[A-Z][a-z]{1,20}){1,2}\b", ("patient", "client", "employee", "applicant", "meeting", "schedule", "appointment", "referred", "contact", "resident", "beneficiary", "spouse", "guardian", "account holder", "policyholder", "subscriber", "cardholder", "dependent", "diagnosed", "prescribed", "treatment", "record", "dob", "ssn", "passport", "license", "address", "phone")),
    Context("ctx_name", "person_name", 0.85, 150, r"\m[A-Z][a-z]{1,20}\s+[A-Z][a-z]{1,20}\b", ("patient", "client", "employee", "applicant", "meeting with", "schedule", "appointment", "referred by", "emergency contact", "next of kin", "guardian", "beneficiary", "diagnosed", "prescribed", "treatment", "dob", "date of birth", "ssn", "social security", "passport", "mrn", "medical record",
        "account holder", "policyholder", "her patient", "his patient", "ceo", "cto", "cfo", "coo", "cio", "ciso", "vp", "svp", "evp", "director", "manager", "president", "chairman", "founder", "co-founder", "partner", "principal", "attorney", "counsel", "officer", "executive", "supervisor", "coordinator",
        "analyst", "engineer", "developer", "architect", "consultant", "specialist", "husband", "wife", "son", "daughter", "father", "mother", "brother", "sister", "friend", "colleague", "neighbor", "signed by", "approved by", "submitted by", "reviewed by", "authored by", "assigned to", "reported by", "cc:", "attn:")),
]


def near_distance(text: Column, start: Column, stop: Column, keywords: tuple[str, ...], window: int, parts: Column | None = None) -> Column:
    """Least gap between the span and a keyword that lies wholly within the window; 0 if they touch; null if none.

    The window is cut out of the text, or of its pieces if they are given, and lowered once; only its characters are looked at.
    """
    wide = max([window, *(len(k) - 1 for k in keywords)])
    begin = F.greatest(F.lit(0), start - wide)

    def least(low: Column) -> Column:
        before_at = F.greatest(F.lit(0), start - window)
        before = F.reverse(F.substr(low, before_at - begin + 1, start - before_at))
        after = F.substr(low, stop - begin + 1, F.lit(window))
        inside = F.lit(False)
        for n in sorted({len(k) for k in keywords}):  # an occurrence of n characters within n - 1 of the span overlaps it
            at = F.greatest(F.lit(0), start - (n - 1))
            inside = inside | F.substr(low, at - begin + 1, stop + (n - 1) - at).rlike(_any(k for k in keywords if len(k) == n))
        sides = F.array(F.regexp_instr(before, F.lit(_any(k[::-1] for k in keywords))), F.regexp_instr(after, F.lit(_any(keywords))))
        return F.when(inside, 0).otherwise(F.array_min(F.transform(sides, lambda x: F.when(x > 0, x - 1))))

    near = F.substr(text, begin + 1, stop + wide - begin) if parts is None else cut_out(parts, begin, stop + wide)
    return bound(F.lower(near), least)


def keyword_places(text: Column, keywords: Iterable[str]) -> Column:
    """array<struct<start, stop>> of all occurrences of the keywords, overlapping ones too, whatever their case."""
    words = sorted(set(keywords))
    begins, longest = _any(words), max(map(len, words))

    def found(low: Column) -> Column:
        # pieces begin where a keyword does; the first one may not
        step = lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        starts = F.aggregate(F.split(low, f"(?={begins})", -1), F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")), step, lambda acc: acc["out"])

        def here(at: Column) -> Column:
            own = lambda x: F.array(*(F.struct(at.alias("start"), F.when(F.startswith(x, F.lit(k)), at + len(k)).alias("stop")) for k in words))
            return F.filter(bound(F.substr(low, at + 1, F.lit(longest)), own), lambda p: p["stop"].isNotNull())

        return F.when(low.rlike(begins), F.flatten(F.transform(starts, here))).otherwise(F.expr("cast(array() as array<struct<start:int,stop:int>>)"))

    return bound(F.lower(text), found)


def placed_cues(text: Column, keywords: Iterable[str]) -> Column:
    """What keyword_places gives, by one automaton pass over each text, as an array for each piece of it; null texts have none.

    The column is an Arrow function's, so it must not stand inside a lambda.
    """
    words = sorted(set(keywords))

    def found(batch: pa.Array) -> pa.Array:
        own = ahocorasick.Automaton()
        for w in words:
            own.add_word(w, len(w))
        own.make_automaton()
        starts, stops, inner, outer = [], [], [0], [0]
        for text in batch.to_pylist():
            hits = sorted((at + 1 - n, at + 1) for at, n in own.iter(lowered(text))) if text else []
            done = 0
            for piece in range(len(text or "") // PIECE + 1 if hits else 0):
                end = bisect_left(hits, ((piece + 1) * PIECE, 0), done)
                starts += [a for a, _ in hits[done:end]]
                stops += [b for _, b in hits[done:end]]
                inner.append(len(starts))
                done = end
            outer.append(len(inner) - 1)
        places = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], ["start", "stop"])
        return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), pa.ListArray.from_arrays(pa.array(inner, pa.int32()), places))

    return F.arrow_udf(found, "array<array<struct<start:int,stop:int>>>")(F.make_valid_utf8(text))


def least_gap(places: Column, start: Column, stop: Column, window: int) -> Column:
    """What near_distance gives, from the keywords' places."""
    inside = F.filter(places, lambda p: (p["start"] >= start - window) & (p["stop"] <= stop + window))
    return F.array_min(F.transform(inside, lambda p: F.greatest(F.lit(0), F.when(p["start"] < start, start - p["stop"]).otherwise(p["start"] - stop))))


def _any(words: Iterable[str]) -> str:
    return "|".join(r"\Q" + w + r"\E" for w in words)


def proximity(distance: Column, window: int) -> Column:
    """1 beside the span, falling to 0 at the window's edge."""
    return F.when(distance.isNull() | (distance > window), 0.0).otherwise(1 - distance / window)


def rounded(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def adjusted(confidence: Column, boost: Column, suppress: Column) -> Column:
    """Raised by a near supporting word, lowered by a near opposing one; to three decimals."""
    up = F.least(F.lit(1.0), confidence + (1 - confidence) * boost * 0.4)
    return rounded(F.greatest(F.lit(0.0), up - up * suppress * 0.5))


def context_spans(text: Column, context: Context, ord_: int = 0) -> Column:
    """Pattern hits with their score, in the row: those of at least 0.3 whose confidence times score reaches 0.5."""
    held = screened(text, [(context.whole(), False)])
    hits = spans(text, context.java(), held=F.array_contains(held, 0))
    cues = placed_cues(text, context.keywords)

    def near_of(s: Column, cues: Column) -> Column:
        # the cues that begin in the pieces which the window, and the longest cue before it, reach
        first = F.floor(F.greatest(F.lit(0), s["start"] - context.window) / PIECE).cast("int")
        count = F.floor((s["stop"] + context.window) / PIECE).cast("int") - first + 1
        gap = least_gap(F.flatten(F.slice(cues, first + 1, count)), s["start"], s["stop"], context.window)
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), gap.alias("distance"))

    placed = bound(F.struct(hits.alias("hits"), cues.alias("cues")), lambda x: F.transform(x["hits"], lambda s: near_of(s, x["cues"])))
    near = F.filter(placed, lambda s: (proximity(s["distance"], context.window) >= 0.3) & (rounded(proximity(s["distance"], context.window) * context.confidence) >= 0.5))

    def scored(s: Column) -> Column:
        score = proximity(s["distance"], context.window)
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(context.type).alias("type"), s["distance"].alias("distance"), rounded(score).alias("score"), rounded(score * context.confidence).alias("confidence"), F.lit(ord_).alias("ord"))

    return F.transform(near, scored)


def context_candidates(texts: DataFrame, context: Context) -> DataFrame:
    """Long form of context_spans over doc_id, text."""
    found = exploded(texts, "doc_id", array=context_spans(F.col("text"), context), alias="s")
    return found.select("doc_id", F.col("s.start").alias("span_start"), F.col("s.stop").alias("span_end"), "s.type", "s.distance", "s.score", "s.confidence")
