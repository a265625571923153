"""The random field on sentences that share no template with its training table, and the columns of its query."""

import hashlib
import re

from parchmill.llm import pii

#: [kind text] marks what is personal; the rest is not.
UNSEEN = """
Please ask for Mr. [name Harold Finch] at the front desk before noon.
We met Mrs. [name Eleanor Abernathy], who kindly showed us around.
Dr. [name Okonkwo] will see you on the second floor.
The keynote was given by Prof. [name Ingrid Sorensen] of Uppsala.
According to Ms. [name Delgado], the figures were wrong.
Herr [name Weber] hat gestern angerufen.
Ich habe mit Frau [name Petra Vogel] gesprochen.
Monsieur [name Lefebvre] est absent aujourd'hui.
Madame [name Claire Fontaine] vous attend.
Señora [name Ruiz] no pudo venir.
My number is [phone (415) 555-0132], ask for the manager.
You can text [phone 212-555-0187] any time after six.
For bookings dial [phone 020 7946 0958] on weekdays.
Our fax is [phone 303.555.0143] and it is always on.
Reach the night desk: [phone (617) 555-0199].
Her mobile, [phone 0171 555 0123], was switched off.
Write to [email sales at acme dot com] for a quote.
The address is [email john.smith (at) mail (dot) org] as before.
Try [email info [at] museum [dot] net] if nobody answers.
He uses [email bob77 at webmail dot com] for shopping.
SSN [national_id 078-05-1120] was printed on the card.
Her social security number is [national_id 219-09-9999].
The form lists [national_id 457-55-5462] under identity.
National insurance: [national_id 123-45-6789], see the letter.
The meeting starts at nine and ends at noon.
Look at the dot on the map at the corner.
The recipe needs 250 grams of flour and 3 eggs.
In 1998-2004 the plant made 1200 cars a day.
Flight 417 leaves from gate 23 at 10:45.
Chapter 3.14 deals with section 2.7.18 of the manual.
The part number is 884-221-90 and the lot is 55.
He scored 15-13, 15-12 and 15-9 in three games.
She looked at him. Dot by dot the picture grew.
Order 20231105 was shipped on 2023-11-07.
The ratio was 3:2 (see table 12) at the end.
They met at noon. Paris was cold.
""".strip().split("\n")


def unseen():
    for line in UNSEEN:
        text, spans = "", []
        for part in re.split(r"(\[(?:email|phone|name|national_id) (?:\[at\]|\[dot\]|[^\]])*\])", line):
            m = re.fullmatch(r"\[(email|phone|name|national_id) (.*)\]", part)
            if m:
                spans.append((m[1], len(text), len(text) + len(m[2])))
            text += m[2] if m else part
        yield text, spans


def test_precision_and_recall_by_kind():
    rows = list(unseen())
    found = pii.all_spans([t for t, _ in rows], pii.trained(None))
    for kind in ("email", "phone", "name", "national_id"):
        want = {(n, *s[1:]) for n, (_, spans) in enumerate(rows) for s in spans if s[0] == kind}
        got = {(n, a, b) for n, spans in enumerate(found) for k, a, b, base in spans if k == kind}
        print(kind, "recall", len(want & got), "of", len(want), "precision", len(want & got), "of", len(got), [rows[n][0][a:b] for n, a, b in got - want], [rows[n][0][a:b] for n, a, b in want - got])
        assert len(want & got) >= 0.7 * len(want) and len(want & got) >= 0.7 * len(got)


def test_query_columns(spark, tmp_path):
    texts = ["a@b.co, 10.1.2.3 and +49 30 1234567", "card 4111 1111 1111 1111, ask Mr. Smith", None, "", "nothing here", "a@b.co a@b.co", "x" * 100_000 + " a@b.co"]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)] + [(5, texts[5], "en", "s", 0), (None, "1.2.3.4", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, pii.op6_pii(spark, str(tmp_path)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()), key=str)
    want = []
    for doc, text, *_ in rows:
        t = text or ""
        base = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)] + [("ip", *m.span()) for m in re.finditer(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", t)]
        base += [("card", *m.span()) for m in re.finditer(r"4111 1111 1111 1111", t)] + [("phone", *m.span()) for m in re.finditer(r"\+49 30 1234567", t)]
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        every = line + (",name:34:39" if "Mr. Smith" in t else "")
        want.append((doc, *(sum(k == x for x, _, _ in base) for k in ("email", "ip", "card", "phone")), hashlib.sha256(line.encode()).hexdigest(), every))
    assert got == sorted(want, key=str)
