"""Short agreements, written for the structure and clause queries: every branch of a check stands in one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS: list[tuple[int, str]] = [
    (1, "\n\n".join([
        "MUTUAL DISCLOSURE AGREEMENT",
        "WHEREAS the parties wish to explore a venture.",
        "1. Definitions",
        "Confidential Information means business, financial, technical and customer material. It does not include matter in the public domain.",
        "2. Confidentiality",
        "Each party shall keep the material confidential as set out in Section 3.1, 4 and 6-8.",
        "3. Term",
        "3.1. The duties survive for five (5) years, subject to clause 2.",
        "4. Governing Law",
        "This agreement is governed by the laws of England and Wales. The courts of London shall decide, see Annex A.",
        "SIGNED FOR THE PARTIES",
        "Signed by: Ann Title: Director Date: 2026-01-05",
        "Signed by: Bob Title: Director",
    ])),
    (2, "\n\n".join([
        "Section 1: Scope",
        "The receiving party alone shall protect what it learns in perpetuity.",
        "Section 2: Law",
        "This paper is governed by the laws of Delaware. The seat of arbitration is Dubai.",
        "Section 2: Orders",
        "Orders follow Section 2 and Article 9.",
        "Section 2(a): Forms",
        "Forms will follow.",
    ])),
    (3, "\n\n".join(["1. Our Product", "Fast and light.", "2. Our Market", "Large and old."])),
    (4, "\n\n".join([
        "Acme is a company incorporated under the laws of Ontario.",
        "Confidential Information includes information in the public domain.",
        "The recipient shall not compete and shall not solicit staff; a penalty of ten units applies.",
        "Duties last 18 months, but trade secrets stay secret for ten years, as statute demands.",
        "This deed is governed by the laws of Delaware or such other place as is to be agreed.",
    ])),
    (5, "\n\n".join([
        "Both parties agree to keep secrets, and the buyer holds a perpetual licence to the software.",
        "Governing law: to be agreed.",
        "Either side may use what was independently developed without use of the secrets; seven years is the term.",
        "Confidential Information means the business plan.",
    ])),
    (6, "\n\n".join([
        "The laws of Norway matter: this letter is governed by the laws of Norway.",
        "Receiving party means the buyer. What is independently developed is free.",
        "By: Cy",
        "Confidential Information means business, financial, technical and commercial matter, nothing publicly available.",
    ])),
    (7, "One line\nand another\n\n \n"),
]

#: (doc_id, id, index, text) of every paragraph.
PARAGRAPHS = [(d, f"p{k}", k, p) for d, t in DOCUMENTS for k, p in enumerate((x.strip() for x in t.split("\n\n") if x.strip()), 1)]


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOCUMENTS, "doc_id long, text string")


def values(columns: str, rows: list[tuple]) -> str:
    """SQL for rows of literals; columns as "name TYPE, ..."."""
    names, kinds = zip(*(c.strip().split(" ", 1) for c in columns.split(",")), strict=True)
    one = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)
    body = ", ".join("(" + ", ".join(f"CAST({one(v)} AS {k})" for v, k in zip(r, kinds, strict=True)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({', '.join(f'"{n}"' for n in names)})"


DOCUMENTS_SQL = f"({values('doc_id BIGINT, text VARCHAR', DOCUMENTS)})"
PARAGRAPHS_SQL = f"({values('doc_id BIGINT, id VARCHAR, index INTEGER, text VARCHAR', PARAGRAPHS)})"
