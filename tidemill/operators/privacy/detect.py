"""Detectors over free text and column names.

Rules are regular expressions with a value group, a check and, for some, words that must stand near. They run in Arrow
batches, as offsets are needed; texts go to them once however many rules there are.
"""

from __future__ import annotations

import base64
import ipaddress
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.validators import CARD_GROUPS, NETWORKS, VIN_VALUES

SPAN = "struct<start:int,end:int,type:string,confidence:double,source:string,detector:string,validated:boolean>"


def _digits(v: str) -> str:
    return re.sub(r"\D", "", v)


def luhn(v: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(_digits(v))):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0 and bool(_digits(v))


def card(v: str) -> bool:
    d = _digits(v)
    lengths = next((ns for width, low, high, ns in NETWORKS if low <= int(d[:width] or 0) <= high), ())
    return len(d) in lengths and luhn(d) and len(set(d)) > 1 and bool(v.isdigit() or re.match(CARD_GROUPS, v))


def iban(v: str) -> bool:
    s = re.sub(r"[ -]", "", v).upper()
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ssn(v: str) -> bool:
    d = _digits(v)
    return len(d) == 9 and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def routing(v: str) -> bool:
    d = [int(c) for c in v]
    return (3 * (d[0] + d[3] + d[6]) + 7 * (d[1] + d[4] + d[7]) + d[2] + d[5] + d[8]) % 10 == 0 and (int(v[:2]) <= 12 or 21 <= int(v[:2]) <= 32 or 61 <= int(v[:2]) <= 72 or v[:2] == "80")


def jwt(v: str) -> bool:
    try:
        head = v.split(".")[0]
        return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))), (dict, list))
    except ValueError:
        return False


def address(v: str) -> bool:
    try:
        ip = ipaddress.ip_address(v)
    except ValueError:
        return False
    groups = [g for g in v.split(":") if g]
    return ip.version == 4 or len(groups) >= 3 or "::" in v and len(groups) == 2


def vin(v: str) -> bool:
    weights = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
    total = sum((int(c) if c.isdigit() else VIN_VALUES.get(c, 0)) * w for c, w in zip(v.upper(), weights)) % 11
    return v.upper()[8] == ("X" if total == 10 else str(total)) and any(c.isalpha() for c in v) and any(c.isdigit() for c in v)


def has_digit(v: str) -> bool:
    return any(c.isdigit() for c in v)


@dataclass(frozen=True)
class Rule:
    name: str
    type: str
    confidence: float
    pattern: re.Pattern
    check: Callable[[str], bool] | None = None
    near: re.Pattern | None = None
    before: int = 0
    after: int = 0
    validated: bool = False
    hint: tuple[str, ...] = ()  # the text must hold one of these, else the rule is not tried; in lower case if folded
    folded: bool = False
    digit: bool = False  # the text must hold a digit


def _rule(name, type_, confidence, pattern, check=None, near=None, before=0, after=0, validated=False, hint=(), digit=False, flags=0):
    return Rule(name, type_, confidence, re.compile(pattern, flags), check, re.compile(near, re.I) if near else None, before, after, validated, hint, bool(flags & re.I), digit)


_I = re.I
_LABEL = r"\s*(?:number|no\.?|num|id|#)?\s*(?:is|:|=|#)?\s*"
_CARD_WORDS, _PHONE_WORDS = r"card|visa|master|amex|credit|debit", r"phone|tel|mobile|cell|call|fax|text|whatsapp"

RULES = [
    _rule("private-key", "PRIVATE_KEY", 0.99, r"(?P<v>-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[\s\S]{1,8000}?-----END [A-Z ]{0,30}PRIVATE KEY-----)", validated=True, hint=("PRIVATE KEY",)),
    _rule("jwt", "ACCESS_TOKEN", 0.98, r"\b(?P<v>eyJ[\w-]{5,2000}\.[\w-]{5,4000}\.[\w-]{5,2000})", jwt, validated=True, hint=("eyJ",)),
    _rule("bearer", "ACCESS_TOKEN", 0.92, r"\bbearer\s+(?P<v>[\w.~+/-]{16,2000}=*)", has_digit, flags=_I, hint=("bearer",), digit=True),
    _rule("api-key", "API_KEY", 0.97, r"\b(?P<v>(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[\w-]{35}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,})\b", validated=True, hint=("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "AIza", "k_live_", "k_test_",)),
    _rule("secret-assignment", "API_KEY", 0.88, r"\b(?:api|secret|access|auth)[_-]?(?:key|token|secret)[\"']?\s*[:=]\s*[\"']?(?P<v>[\w./+-]{12,200})", has_digit, flags=_I, hint=("key", "token", "secret",), digit=True),
    _rule("url-credentials", "PASSWORD", 0.95, r"://[^\s/:@]{1,80}:(?P<v>[^\s/@]{1,200})@", hint=("://",)),
    _rule("password", "PASSWORD", 0.9, r"\b(?:password|passwd|pwd|passphrase)[\"']?\s*(?:is|:|=)\s*[\"']?(?P<v>[^\s\"',;]{3,100})", flags=_I, hint=("pass", "pwd",)),
    _rule("cvv", "CVV", 0.9, r"\b(?:cvv2?|cvc2?|security code)\b\s*(?:is|:|=|#)?\s*(?P<v>\d{3,4})\b", flags=_I, hint=("cvv", "cvc", "security code",), digit=True),
    _rule("card-expiry", "CARD_EXPIRATION", 0.85, r"\b(?:exp(?:iry|ires|iration)?(?: date)?|valid (?:thru|until))\b\.?\s*(?:is|:|=)?\s*(?P<v>(?:0[1-9]|1[0-2])\s?[/-]\s?(?:20)?\d{2})\b", flags=_I, hint=("exp", "valid",), digit=True),
    _rule("card", "CREDIT_CARD_NUMBER", 0.97, r"(?<![\w-])(?<!\.)(?P<v>\d{13,19}|\d{4}(?P<sep>[ -])(?:\d{6}(?P=sep)\d{4,5}|(?:\d{4}(?P=sep)){2}\d{4}(?:(?P=sep)\d{3})?))(?![\w-])", card, validated=True, digit=True),
    _rule("card-last4", "CREDIT_CARD_NUMBER", 0.7, r"\b(?:ending(?: in| with)?|last (?:four|4)(?: digits)?)\s*(?:are|is|:)?\s*(?P<v>\d{4})\b", near=_CARD_WORDS, before=60, flags=_I, hint=("ending", "last four", "last 4",), digit=True),
    _rule("iban", "IBAN", 0.97, r"\b(?P<v>[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?))\b", iban, validated=True, digit=True),
    _rule("routing", "ROUTING_NUMBER", 0.85, r"\b(?P<v>\d{9})\b", routing, near=r"routing|aba|rtn", before=40, digit=True),
    _rule("bank-account", "BANK_ACCOUNT_NUMBER", 0.8, r"\b(?:bank|checking|savings) (?:account|acct)" + _LABEL + r"(?P<v>\d[\d -]{5,20}\d)\b", flags=_I, hint=("account", "acct",), digit=True),
    _rule("ssn", "SSN", 0.9, r"(?<![\w-])(?P<v>\d{3}-\d{2}-\d{4})(?![\w-])", ssn, validated=True, digit=True),
    _rule("ssn-plain", "SSN", 0.85, r"(?<![\w-])(?P<v>\d{3} ?\d{2} ?\d{4})(?![\w-])", ssn, near=r"ssn|social security", before=40, digit=True),
    _rule("ein", "TAX_ID", 0.85, r"\b(?P<v>\d{2}-\d{7})\b", near=r"ein|tax|employer id", before=40, digit=True),
    _rule("tax-id", "TAX_ID", 0.8, r"\b(?:tax (?:id|number)|tin|vat)" + _LABEL + r"(?P<v>[A-Z]{0,3}\d[\d-]{5,14})\b", flags=_I, hint=("tax", "tin", "vat",), digit=True),
    _rule("national-id", "NATIONAL_ID", 0.8, r"\bnational (?:id|identity|insurance)" + _LABEL + r"(?P<v>[A-Z0-9][A-Z0-9 -]{4,20}[A-Z0-9])\b", has_digit, flags=_I, hint=("national",), digit=True),
    _rule("uk-nino", "NATIONAL_ID", 0.75, r"\b(?P<v>[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D])\b", digit=True),
    _rule("passport", "PASSPORT_NUMBER", 0.85, r"\bpassport" + _LABEL + r"(?P<v>[A-Z0-9]{6,9})\b", has_digit, flags=_I, hint=("passport",), digit=True),
    _rule("driver-license", "DRIVER_LICENSE", 0.85, r"\bdriv(?:er'?s?|ing) licen[sc]e" + _LABEL + r"(?P<v>[A-Z0-9-]{5,20})\b", has_digit, flags=_I, hint=("driv",), digit=True),
    _rule("mrn", "MEDICAL_RECORD_NUMBER", 0.88, r"\b(?:mrn|medical record)" + _LABEL + r"(?P<v>[A-Z]{0,3}-?\d{4,12})\b", flags=_I, hint=("mrn", "medical record",), digit=True),
    _rule("insurance-id", "HEALTH_INSURANCE_ID", 0.75, r"\b(?:insurance|member|policy) (?:id|number|no\.?)\s*(?:is|:|=|#)?\s*(?P<v>[A-Z0-9-]{6,20})\b", has_digit, flags=_I, hint=("insurance", "member", "policy",), digit=True),
    _rule("npi", "MEDICAL_LICENSE", 0.95, r"\bnpi" + _LABEL + r"(?P<v>[12]\d{9})\b", lambda v: luhn("80840" + v), validated=True, flags=_I, hint=("npi",), digit=True),
    _rule("email", "EMAIL_ADDRESS", 0.97, r"(?<![\w.+-])(?P<v>[A-Za-z0-9_][\w.+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24})\b", lambda v: ".." not in v, validated=True, hint=("@",)),
    _rule("phone-international", "PHONE_NUMBER", 0.9, r"(?<![\w+])(?P<v>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4})\b", lambda v: 8 <= len(_digits(v)) <= 15, hint=("+",), digit=True),
    _rule("phone-nanp", "PHONE_NUMBER", 0.9, r"(?<![\w.-])(?P<v>(?:1[ .-])?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4})(?![\w-])", digit=True),
    _rule("phone-uk-mobile", "PHONE_NUMBER", 0.85, r"(?<!\w)(?P<v>0(?=7)(?:\d{10}|\d{4} (?:\d{6}|\d{3} \d{3})))\b", digit=True),
    _rule("phone-local", "PHONE_NUMBER", 0.8, r"(?<![\w-])(?P<v>\d{3}[ .-]\d{4})(?![\w-])", near=_PHONE_WORDS, before=48, after=16, digit=True),
    _rule("phone-digits", "PHONE_NUMBER", 0.75, r"\b(?P<v>\d{10,11})\b", near=_PHONE_WORDS, before=48, after=16, digit=True),
    _rule("url", "URL", 0.9, r"\b(?P<v>(?:https?|ftp)://[^\s<>\"']{3,500}[^\s<>\"'.,;:!?)\]])", hint=("://",)),
    _rule("ipv4", "IP_ADDRESS", 0.95, r"(?<![\w.])(?P<v>\d{1,3}(?:\.\d{1,3}){3})(?![\w]|\.\d)", address, validated=True, digit=True),
    _rule("ipv6", "IP_ADDRESS", 0.9, r"(?<![\w:.])(?P<v>(?=[^\s:]*:[^\s:]*:)[0-9A-Fa-f:]{3,39})(?![\w:])", address, validated=True, hint=(":",)),
    _rule("mac", "MAC_ADDRESS", 0.9, r"(?<![\w:-])(?P<v>(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}|(?:[0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2})(?![\w:-])", validated=True),
    _rule("imei", "DEVICE_ID", 0.95, r"\bimei" + _LABEL + r"(?P<v>\d{15})\b", luhn, validated=True, flags=_I, hint=("imei",), digit=True),
    _rule("uuid", "OTHER_UNIQUE_IDENTIFIER", 0.85, r"\b(?P<v>[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\b", validated=True, flags=_I, hint=("-",)),
    _rule("vin", "VEHICLE_IDENTIFIER", 0.95, r"\b(?P<v>[A-HJ-NPR-Z0-9]{17})\b", vin, validated=True, digit=True),
    _rule("plate", "LICENSE_PLATE", 0.8, r"\b(?:licen[sc]e|number|registration) plate" + _LABEL + r"(?P<v>[A-Z0-9]{2,4}[ -]?[A-Z0-9]{2,4})\b", has_digit, flags=_I, hint=("plate",), digit=True),
    _rule("dob", "DATE_OF_BIRTH", 0.9, r"\b(?:dob|date of birth|birth ?date|born(?: on)?)\b\s*(?:is|:|=)?\s*(?P<v>\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}|\d{1,2} [A-Z][a-z]{2,8} \d{4}|[A-Z][a-z]{2,8} \d{1,2},? \d{4})", flags=_I, hint=("dob", "birth", "born",), digit=True),
    _rule("age", "AGE", 0.8, r"\b(?P<v>\d{1,3})(?:[ -]years?[ -]old|[ -]y/?o)\b", lambda v: int(v) <= 120, flags=_I, hint=("year", "y/o", "yo",), digit=True),
    _rule("age-labelled", "AGE", 0.75, r"\b(?:age|aged)\s*(?:is|:|=)?\s*(?P<v>\d{1,3})\b", lambda v: int(v) <= 120, flags=_I, hint=("age",), digit=True),
    _rule("employee-id", "EMPLOYEE_ID", 0.8, r"\bemployee (?:id|number|no\.?|#)\s*(?:is|:|=|#)?\s*(?P<v>[A-Z]{0,4}-?\d{3,12})\b", flags=_I, hint=("employee",), digit=True),
    _rule("customer-id", "CUSTOMER_ID", 0.8, r"\b(?:customer|client) (?:id|number|no\.?|#)\s*(?:is|:|=|#)?\s*(?P<v>[A-Z]{0,4}-?\d{3,12})\b", flags=_I, hint=("customer", "client",), digit=True),
    _rule("account-id", "ACCOUNT_ID", 0.8, r"\baccount (?:id|number|no\.?|#)\s*(?:is|:|=|#)?\s*(?P<v>[A-Z]{0,4}-?\d{3,14})\b", flags=_I, hint=("account",), digit=True),
    _rule("username", "USERNAME", 0.8, r"\b(?:user ?name|login|user id)\s*(?:is|:|=)\s*[\"']?(?P<v>[\w.-]{3,40})", flags=_I, hint=("user", "login",)),
    _rule("handle", "USERNAME", 0.7, r"(?<![\w@.])(?P<v>@[A-Za-z_]\w{2,29})\b(?!\.\w)", hint=("@",)),
    _rule("street-address", "STREET_ADDRESS", 0.85, r"\b(?P<v>\d{1,6} (?:[NSEW]\.? )?(?:[A-Z][\w'-]{1,20} ){1,4}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Way|Place|Pl|Terrace|Square)\b\.?)", digit=True),
    _rule("po-box", "STREET_ADDRESS", 0.85, r"\b(?P<v>(?:post\s+office|p\.?\s?o\.?)\s+box\s+#?\d+)\b", flags=_I, hint=("box",), digit=True),
    _rule("zip-after-state", "POSTAL_CODE", 0.85, r"\b[A-Z][a-z]+,? [A-Z]{2} (?P<v>\d{5}(?:-\d{4})?)\b", digit=True),
    _rule("postal-labelled", "POSTAL_CODE", 0.85, r"\b(?:zip|postal|post) ?code\s*(?:is|:|=)?\s*(?P<v>[A-Z0-9][A-Z0-9 -]{2,9}[A-Z0-9])\b", has_digit, flags=_I, hint=("zip", "post",), digit=True),
    _rule("uk-postcode", "POSTAL_CODE", 0.8, r"\b(?P<v>[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2})\b", digit=True),
    _rule("ca-postcode", "POSTAL_CODE", 0.8, r"\b(?P<v>(?![DFIOQUWZ])[A-Z]\d(?![DFIOQU])[A-Z] ?\d(?![DFIOQU])[A-Z]\d)\b", digit=True),
    _rule("titled-name", "PERSON_NAME", 0.9, r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? (?P<v>[A-Z][\w'-]+(?: [A-Z][\w'-]+){0,2})", hint=("Mr", "Ms", "Dr", "Prof",)),
    _rule("introduced-name", "PERSON_NAME", 0.85, r"\b(?:[Mm]y name is|[Nn]amed|[Nn]ame:) (?P<v>[A-Z][\w'-]+(?: [A-Z][\w'-]+){0,2})", hint=("y name is", "amed", "ame:",)),
    _rule("password-bare", "PASSWORD", 0.8, r"\b(?:password|passcode|pwd)\s+(?P<v>(?=[^\s\"',;]{0,63}\d)(?=[^\s\"',;]{0,63}[A-Za-z])[^\s\"',;]{6,64})", lambda v: not v.isalnum() or sum(map(str.isdigit, v)) > 1, flags=_I, hint=("pass", "pwd"), digit=True),
    _rule("card-expiry-long", "CARD_EXPIRATION", 0.8, r"\b(?:exp(?:iry|ires|iration)?(?: date)?|valid (?:thru|until))\b\.?\s*(?:is|on|:|=)?\s*(?P<v>(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]{0,6}\.? \d{4})\b", near=_CARD_WORDS, before=80, flags=_I, hint=("exp", "valid"), digit=True),
    _rule("medical-license", "MEDICAL_LICENSE", 0.85, r"\b(?:medical|physician|nursing|dea) (?:licen[sc]e|registration)" + _LABEL + r"(?P<v>[A-Z]{0,3}-?\d{4,10})\b", flags=_I, hint=("licen", "registration"), digit=True),
    _rule("device-id", "DEVICE_ID", 0.8, r"\b(?:device|serial|android|advertising) ?(?:id|identifier|number)\b\s*(?:is|:|=|#)?\s*(?P<v>[A-Za-z0-9][A-Za-z0-9:-]{6,40})", has_digit, flags=_I, hint=("device", "serial", "android", "advertising"), digit=True),
    _rule("vin-labelled", "VEHICLE_IDENTIFIER", 0.8, r"\b(?:vin|chassis)" + _LABEL + r"(?P<v>[A-HJ-NPR-Z0-9]{11,17})\b", has_digit, flags=_I, hint=("vin", "chassis"), digit=True),
    _rule("phone-grouped", "PHONE_NUMBER", 0.7, r"(?<![\w.-])(?P<v>0\d{1,4}(?:[ /-]\d{2,5}){1,4})(?![\w-])", lambda v: 8 <= len(_digits(v)) <= 12, near=_PHONE_WORDS, before=48, after=16, digit=True),
    _rule("lives-at", "LOCATION", 0.7, r"\b(?:lives?|living|resides?|residing|located) (?:at|in|on) (?P<v>\d{0,5} ?[A-Z][\w'-]{1,24}(?: [A-Z][\w'-]{1,24}){0,3})", hint=("liv", "resid", "located")),
    _rule("works-at", "EMPLOYER", 0.7, r"\b(?:works?|working|employed) (?:at|for|by) (?P<v>[A-Z][\w&'-]{1,24}(?: [A-Z&][\w&'-]{0,24}){0,3})", hint=("work", "employed")),
    _rule("relative-name", "RELATIVE_NAME", 0.85, r"\b(?:[Mm]y|[Hh]is|[Hh]er|[Tt]heir|[Oo]ur) (?:wife|husband|son|daughter|mother|father|sister|brother|partner|spouse|uncle|aunt|cousin)(?:,| is| named| called)? (?P<v>[A-Z][\w'-]+(?: [A-Z][\w'-]+)?)", hint=("wife", "husband", "son", "daughter", "mother", "father", "sister", "brother", "partner", "spouse", "uncle", "aunt", "cousin")),
    _rule("greeted-name", "PERSON_NAME", 0.75, r"\b(?:Dear|Hello|Hi|Regards,|Thanks,|Sincerely,)\s+(?P<v>[A-Z][a-z][\w'-]* [A-Z][\w'-]+)", hint=("Dear", "Hello", "Hi", "Regards", "Thanks", "Sincerely")),
    _rule("introduced-script", "PERSON_NAME", 0.7, r"(?:меня зовут|我叫|私の名前は|اسمي)\s*(?P<v>[^\W\d_]{2,20}(?: [^\W\d_]{2,20})?)", hint=("зовут", "我叫", "名前", "اسمي")),
]


_DIGIT = re.compile(r"\d")


def found(text: str, rules: list[Rule] = RULES) -> list[dict]:
    """Spans of one text, in code points."""
    out, low, digit = [], text.lower(), bool(_DIGIT.search(text))
    for r in rules:
        if r.digit and not digit:
            continue
        if r.hint:
            where = low if r.folded else text
            if not any(h in where for h in r.hint):
                continue
        for m in r.pattern.finditer(text):
            a, b = m.span("v")
            if r.check and not r.check(m["v"]):
                continue
            if r.near and not r.near.search(text, max(0, a - r.before), a) and not (r.after and r.near.search(text, b, min(len(text), b + r.after))):
                continue
            out.append({"start": a, "end": b, "type": r.type, "confidence": r.confidence, "source": "validated" if r.validated else "deterministic", "detector": r.name, "validated": r.validated})
    return out


SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is small: a small file may be one row group, and so one task. What is larger has tasks enough."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SPREAD_BYTES else df


def detected(df: DataFrame, text: str = "text", spans: str = "spans", types: list[str] | None = None, errors: str | None = None, rules: list[Rule] = RULES) -> DataFrame:
    """df with the spans found in a text column, of the wanted types or all. Null texts have none. With `errors`, a text
    on which a rule fails has null spans and the error's class in that column, in place of failing the job."""
    keep = [c for c in df.columns if c not in (spans, errors)]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("confidence", pa.float64()), ("source", pa.string()), ("detector", pa.string()), ("validated", pa.bool_())]))
    rules = [r for r in rules if types is None or r.type in types]

    def tried(t: str) -> tuple[list[dict] | None, str | None]:
        try:
            return found(t, rules), None
        except Exception as e:  # whatever it is, the text counts as not looked at
            return None, type(e).__name__

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            if errors:
                both = [tried(t or "") for t in texts]
                own = [pa.array([s for s, _ in both], kind), pa.array([e for _, e in both], pa.string())]
            else:
                own = [pa.array([found(t or "", rules) for t in texts], kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *own], names=[*keep, spans, errors][: len(keep) + len(own)])

    pick = spread(df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text")))
    out = pick.drop("__text").withColumn(spans, F.expr(f"CAST(NULL AS array<{SPAN}>)"))
    return pick.mapInArrow(tasks, (out.withColumn(errors, F.lit(None).cast("string")) if errors else out).schema)


# --- columns by their names ---

#: Last words and whole names of columns, and what they hold; the first rule that fits.
NAME_RULES = [
    ("PASSWORD", ["password", "passwd", "pwd", "passphrase"]),
    ("PRIVATE_KEY", ["private_key", "ssh_key"]),
    ("API_KEY", ["api_key", "apikey", "secret_key", "client_secret"]),
    ("ACCESS_TOKEN", ["token", "access_token", "refresh_token", "session_token", "jwt"]),
    ("EMAIL_ADDRESS", ["email", "email_address", "mail", "e_mail"]),
    ("PHONE_NUMBER", ["phone", "telephone", "mobile", "cell", "fax", "msisdn", "phone_number"]),
    ("SSN", ["ssn", "social_security_number"]),
    ("NATIONAL_ID", ["national_id", "nino", "citizen_id"]),
    ("PASSPORT_NUMBER", ["passport", "passport_number", "passport_no"]),
    ("DRIVER_LICENSE", ["driver_license", "driving_licence", "drivers_license"]),
    ("TAX_ID", ["tax_id", "tin", "ein", "vat_number"]),
    ("MEDICAL_RECORD_NUMBER", ["mrn", "medical_record_number"]),
    ("CREDIT_CARD_NUMBER", ["card_number", "credit_card", "cc_number", "pan"]),
    ("CVV", ["cvv", "cvc"]),
    ("IBAN", ["iban"]),
    ("ROUTING_NUMBER", ["routing_number", "aba"]),
    ("BANK_ACCOUNT_NUMBER", ["bank_account", "account_number"]),
    ("IP_ADDRESS", ["ip", "ip_address", "client_ip"]),
    ("MAC_ADDRESS", ["mac", "mac_address"]),
    ("DEVICE_ID", ["device_id", "imei"]),
    ("VEHICLE_IDENTIFIER", ["vin"]),
    ("DATE_OF_BIRTH", ["dob", "birthdate", "birthday", "date_of_birth"]),
    ("AGE", ["age"]),
    ("USERNAME", ["username", "login", "user_name", "handle"]),
    ("EMPLOYEE_ID", ["employee_id"]),
    ("CUSTOMER_ID", ["custkey", "customer_id"]),
    ("STREET_ADDRESS", ["address", "street", "street_address"]),
    ("POSTAL_CODE", ["zip", "zipcode", "postcode", "postal_code"]),
    ("CARD_EXPIRATION", ["card_expiry", "card_exp", "expiry", "exp_date", "exp_month", "exp_year"]),
    ("HEALTH_INSURANCE_ID", ["insurance_id", "policy_number", "subscriber_id", "member_id"]),
    ("MEDICAL_LICENSE", ["npi", "dea_number", "medical_license"]),
    ("LICENSE_PLATE", ["plate", "plate_number", "license_plate", "number_plate"]),
    ("ACCOUNT_ID", ["account_id", "acct_id"]),
    ("BIOMETRIC_IDENTIFIER", ["biometric", "fingerprint_template", "face_id", "voiceprint", "retina_scan"]),
    ("LOCATION", ["latitude", "longitude", "lat", "lng", "lon", "geolocation", "coordinates", "gps"]),
    ("EMPLOYER", ["employer", "company", "organization", "organisation", "workplace"]),
    ("OCCUPATION", ["occupation", "profession", "job_title"]),
    ("STATE", ["province", "state_code", "county"]),
    ("CITY", ["city", "town"]),
    ("COUNTRY", ["country", "nation"]),
    ("URL", ["url", "website", "homepage"]),
    ("PERSON_NAME", ["first_name", "last_name", "full_name", "surname", "fullname"]),
]


def name_words(name: Column) -> Column:
    apart = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+", "_")
    return F.filter(F.split(F.lower(apart), "_"), lambda w: w != "")


def column_class(name: Column) -> Column:
    """The entity type a column's name tells, by the whole name or its last words; null if none."""
    words = name_words(name)
    whole = F.array_join(words, "_")
    out = None
    for kind, keys in NAME_RULES:
        test = whole.rlike("(^|_)(" + "|".join(keys) + ")$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out
