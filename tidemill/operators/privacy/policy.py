"""What happens to each type of entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.stored import apart

LEAST_CONFIDENCE = 0.5
#: Entity types, the tags of their placeholders, and what is done to them.
TYPES = [
    ("PERSON_NAME", "PERSON", "pseudonymize"),
    ("RELATIVE_NAME", "RELATIVE", "pseudonymize"),
    ("EMAIL_ADDRESS", "EMAIL", "pseudonymize"),
    ("PHONE_NUMBER", "PHONE", "pseudonymize"),
    ("STREET_ADDRESS", "ADDRESS", "pseudonymize"),
    ("POSTAL_CODE", "POSTCODE", "pseudonymize"),
    ("LOCATION", "LOCATION", "pseudonymize"),
    ("DATE_OF_BIRTH", "DOB", "pseudonymize"),
    ("SSN", "SSN", "pseudonymize"),
    ("NATIONAL_ID", "NATIONAL_ID", "pseudonymize"),
    ("PASSPORT_NUMBER", "PASSPORT", "pseudonymize"),
    ("DRIVER_LICENSE", "DRIVER_LICENSE", "pseudonymize"),
    ("TAX_ID", "TAX_ID", "pseudonymize"),
    ("MEDICAL_RECORD_NUMBER", "MRN", "pseudonymize"),
    ("HEALTH_INSURANCE_ID", "INSURANCE_ID", "pseudonymize"),
    ("MEDICAL_LICENSE", "MEDICAL_LICENSE", "pseudonymize"),
    ("BANK_ACCOUNT_NUMBER", "BANK_ACCOUNT", "pseudonymize"),
    ("ROUTING_NUMBER", "ROUTING", "pseudonymize"),
    ("IBAN", "IBAN", "pseudonymize"),
    ("IP_ADDRESS", "IP", "pseudonymize"),
    ("MAC_ADDRESS", "MAC", "pseudonymize"),
    ("DEVICE_ID", "DEVICE_ID", "pseudonymize"),
    ("LICENSE_PLATE", "PLATE", "pseudonymize"),
    ("VEHICLE_IDENTIFIER", "VIN", "pseudonymize"),
    ("USERNAME", "USERNAME", "pseudonymize"),
    ("EMPLOYEE_ID", "EMPLOYEE_ID", "pseudonymize"),
    ("CUSTOMER_ID", "CUSTOMER_ID", "pseudonymize"),
    ("ACCOUNT_ID", "ACCOUNT_ID", "pseudonymize"),
    ("URL", "URL", "pseudonymize"),
    ("EMPLOYER", "EMPLOYER", "pseudonymize"),
    ("ORGANIZATION", "ORG", "pseudonymize"),
    ("OTHER_UNIQUE_IDENTIFIER", "ID", "pseudonymize"),
    ("UNKNOWN_SENSITIVE", "SENSITIVE", "pseudonymize"),
    ("CITY", "CITY", "preserve"),
    ("STATE", "STATE", "preserve"),
    ("COUNTRY", "COUNTRY", "preserve"),
    ("AGE", "AGE", "preserve"),
    ("OCCUPATION", "OCCUPATION", "preserve"),
    ("CREDIT_CARD_NUMBER", "CARD", "mask"),
    ("CVV", "CVV", "redact"),
    ("CARD_EXPIRATION", "CARD_EXPIRY", "redact"),
    ("BIOMETRIC_IDENTIFIER", "BIOMETRIC", "redact"),
    ("API_KEY", "API_KEY", "redact"),
    ("ACCESS_TOKEN", "TOKEN", "redact"),
    ("PASSWORD", "PASSWORD", "redact"),
    ("PRIVATE_KEY", "PRIVATE_KEY", "redact"),
]
#: type, tag, action, restorable
ROWS = [(*row, row[2] == "pseudonymize") for row in TYPES]
ACTIONS = {row[2] for row in TYPES}
#: Names of the same people share their pseudonyms.
SAME_IDENTITY = {"RELATIVE_NAME": "PERSON_NAME"}


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, "type string, tag string, action string, restorable boolean")


def validate(rows: list[tuple]) -> None:
    """Every type has one rule and a known action; withheld values are not restorable."""
    types = [r[0] for r in rows]
    missing = {r[0] for r in ROWS} - set(types)
    if missing or len(types) != len(set(types)):
        raise ValueError(f"{len(missing)} types lack a rule, {len(types) - len(set(types))} have several")
    if any(r[2] not in ACTIONS or r[3] and r[2] != "pseudonymize" for r in rows):
        raise ValueError("a rule's action can't be carried out")


def looked_up(type_: Column, what: int) -> Column:
    """A policy value (1 tag, 2 action, 3 restorable) as an expression: 46 fixed rows need no join."""
    pairs = [x for r in ROWS for x in (F.lit(r[0]), F.lit(r[what]))]
    return F.element_at(F.create_map(*pairs), type_)


def pseudonyms(values: DataFrame, secret: str, least: int = 6) -> DataFrame:
    """identity, value, pseudonym for distinct (type, value): a keyed digest's first hex digits, more of them where two values
    would share them. The key keeps short values from being guessed."""
    identity = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SAME_IDENTITY.items() for x in kv]), F.col("type")), F.col("type"))
    rows = values.select(identity.alias("identity"), "value").distinct()
    inner = F.sha2(F.concat(F.lit(secret + "\x01"), F.col("identity"), F.lit("\x00"), F.col("value")), 256)
    rows = rows.withColumn("digest", F.sha2(F.concat(F.lit(secret + "\x02"), inner), 256)).withColumn("short", F.substring("digest", 1, least))
    alone = rows.groupBy("short").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(apart(alone), "short").select("identity", "value", F.when(F.col("n") == 1, F.col("short")).otherwise(F.substring("digest", 1, 4 * least)).alias("pseudonym"))
