"""All documents come back; only what was redacted or masked is left as markers."""

import hashlib

from tidemill.operators.privacy import policy
from tidemill.plans import registry

SF = "/root/testdata/sf0.001"


def test_every_document_is_restored(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    tags, spans = {r[0]: r[1] for r in policy.ROWS}, {}
    for r in registry.queries()["g31_primary"](spark, SF).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end, r.type, r.action))
    got = {r.doc_id: r.digest for r in registry.queries()["g46_restore_all"](spark, SF).collect()}
    assert got.keys() == docs.keys()
    changed = 0
    for k, text in docs.items():
        want, at = "", 0
        for start, end, kind, action in sorted(spans.get(k, [])):
            value = text[start:end]
            digits = "".join(c for c in value if c.isalnum())
            shown = f":{digits[-4:]}" if len(digits) >= 8 else ""
            new = {"redact": f"[[redacted:{tags[kind]}]]", "mask": f"[[masked:{tags[kind]}{shown}]]"}.get(action, value)
            want, at = want + text[at:start] + new, end
        want += text[at:] if text is not None else ""
        assert got[k] == (None if text is None else hashlib.md5(want.encode()).hexdigest()), k
        changed += k in spans
    assert changed > 5
