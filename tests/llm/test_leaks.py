import base64
import email
import quopri
import re
import html as html_

from locusmill.llm import leaks
from locusmill.llm.mail import visible

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()
PASSAGE = " ".join(WORDS)
HEAD = "From: a@b.example\nSubject: x\n"


def mail(body, kind="text/plain", coding=None):
    return HEAD + f"Content-Type: {kind}; charset=utf-8\n" + (f"Content-Transfer-Encoding: {coding}\n" if coding else "") + "\n" + body


def run(spark, texts, items=((1, PASSAGE), (2, "short one"), (3, None), (4, PASSAGE))):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    held = spark.createDataFrame([(i, p, "z") for i, p in items], "item_id long, passage string, doc_id string")
    return sorted((r["doc_id"], r["item_id"], r["words"], r["start_pos"], r["end_pos"]) for r in leaks.places(docs, held).collect())


def found(spark, texts, **k):
    return {(r[0], r[1]) for r in run(spark, texts, **k)}


def test_readings(spark):
    twelve, eleven = " ".join(WORDS[5:17]), " ".join(WORDS[5:16])
    texts = [
        mail(twelve), mail(eleven), mail("> " + "\n> > ".join(WORDS[2:15])), mail(quopri.encodestring((twelve + " é").encode()).decode().replace("theta", "thet=\na"), coding="quoted-printable"),
        mail(base64.encodebytes(twelve.encode()).decode(), coding="base64"), mail("<p>" + twelve.replace(" ", "<br>\n") + "</p>", "text/html"), mail("<b>al</b>pha " + twelve.replace("eta", "<i>e</i>ta"), "text/html"),
        mail(twelve.upper().replace(" ", "---")), mail(twelve.replace("kappa", "kappax")), None, "", "   ", twelve,
        HEAD + "Content-Type: multipart/mixed;\n boundary=\"b1\"\n\n--b1\nContent-Type: text/plain\n\nhi\n--b1\nContent-Type: text/plain; name=\"f.txt\"\nContent-Transfer-Encoding: base64\n\n" + base64.encodebytes(twelve.encode()).decode() + "--b1--\n",
        HEAD + "Content-Type: multipart/mixed;\n boundary=\"b1\"\n\n--b1\nContent-Type: text/plain\n\n" + twelve, mail("x " * 400_000 + twelve), mail("&#97;lpha beta&nbsp;" + " ".join(WORDS[2:13]), "text/html"), mail(twelve + " " + twelve),
    ]
    hit = {0, 2, 3, 4, 5, 6, 7, 12, 13, 14, 15, 16, 17}
    assert found(spark, texts) == {(d, i) for d in hit for i in (1, 4)}


def test_places(spark):
    body = "Hello. " + " ".join(WORDS[3:18]) + " bye"
    text = mail(body)
    d, item, n, s, e = run(spark, [text], items=[(1, PASSAGE)])[0]
    assert n == 15 and text[s:e] == " ".join(WORDS[3:18])


def test_empty(spark):
    assert run(spark, [], items=[(1, PASSAGE)]) == []
    assert run(spark, [PASSAGE], items=[]) == []


def test_against_the_mail_library(spark, data):
    from locusmill.sources.tables import table

    docs = [(r["doc_id"], r["text"]) for r in table(spark, data, "documents").select("doc_id", "text").collect()]
    items = {r["item_id"]: re.findall("[a-z0-9]+", r["passage"].lower()) for r in table(spark, data, "eval_items").collect() if r["passage"]}
    grams = {}
    for i, w in items.items():
        for k in range(len(w) - 11):
            grams.setdefault(" ".join(w[k : k + 12]), set()).add(i)
    want = set()
    for d, t in docs:
        parts = [t or ""]
        for part in email.message_from_string(t or "").walk():
            if part.get_content_maintype() == "text" and (b := part.get_payload(decode=True)):
                x = b.decode("latin-1")
                parts += [x, html_.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<head.*?</head>", " ", x)))]
        for x in parts:
            w = re.findall("[a-z0-9]+", x.lower())
            want |= {(d, i) for k in range(len(w) - 11) for i in grams.get(" ".join(w[k : k + 12]), ())}
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find(leaks.places(table(spark, data, "documents"), table(spark, data, "eval_items"))).collect()}
    assert got >= want and len(got - want) <= 1


def test_deep_nesting(spark):
    t = HEAD + "Content-Type: multipart/mixed; boundary=\"b\"\n\n" + "--b\nContent-Type: multipart/mixed; boundary=\"b\"\n\n" * 50 + "--b\n\nx"
    assert isinstance(list(visible(t)), list)
    deep = "Content-Type: text/plain\nContent-Transfer-Encoding: base64\n\n" + base64.encodebytes(PASSAGE.encode()).decode()
    for i in range(300):
        deep = f"Content-Type: multipart/mixed; boundary=\"b{i}x\"\n\n--b{i}x\n{deep}\n--b{i}x--\n"
    late = mail("<!-- " + "x" * 2_000 + " --><HTML>" + PASSAGE.replace("eta", "e<i>t</i>a"), "text/enriched")
    assert found(spark, [HEAD + deep, late]) == {(d, i) for d in (0, 1) for i in (1, 4)}


def test_places_in_encoded_parts(spark):
    body = "Hello. " + " ".join(WORDS[3:18]) + " bye, " + " ".join(WORDS[:12]) + "\n"
    qp = quopri.encodestring(("é" + body).encode()).decode().replace("theta", "thet=\na").replace("iota", "i=6Fta")
    html = "<p>Hello</p> " + body.replace("iota", "i<b>o</b>ta").replace(" ", "<br>&nbsp;")
    texts = [mail(body), mail(qp, coding="quoted-printable"), mail(html, "text/html"), mail(base64.encodebytes(body.encode()).decode(), coding="base64")]
    got = run(spark, texts, items=[(1, PASSAGE)])
    assert [(d, n) for d, _, n, _, _ in got] == [(d, n) for d in range(4) for n in (12, 15)]
    plain = lambda x: re.findall("[a-z]+", re.sub("<[^>]*>|&nbsp;|=\n", lambda m: "" if m[0][:2] in ("<b", "</", "=\n") and "br" not in m[0] else " ", x).replace("=6F", "o"))
    for d, _, n, s, e in got[:6]:
        assert plain(texts[d][s:e]) == (WORDS[:12] if n == 12 else WORDS[3:18])
    for d, _, n, s, e in got[6:]:
        assert base64.b64decode(texts[3].split("\n\n")[1])  # a run of base64 begins within a group of four
        assert s < e and abs((e - s) - len(" ".join(WORDS[:12] if n == 12 else WORDS[3:18])) * 4 / 3) < 8


def test_questions_and_repeated_places(spark):
    docs = spark.createDataFrame([(0, "so: what was it that ran, he asked"), (1, "what was it that"), (2, (PASSAGE + " and ") * 3)], "doc_id long, text string")
    items = spark.createDataFrame([(7, PASSAGE, "What was it that ran, he?")], "item_id long, passage string, question string")
    got = leaks.places(docs, items)
    assert sorted((r["doc_id"], r["field"], r["words"]) for r in got.collect()) == [(0, "question", 6), *[(2, "passage", 20)] * 3]
    assert [tuple(r) for r in leaks.find(got).collect()] == [(2, 7, 20)]


def test_long_texts_take_time_in_proportion():
    import time

    a, texts = leaks.automaton([(1, "passage", PASSAGE)], 12)
    took = []
    for n in (2_000, 16_000):
        data = ((" ".join(WORDS[:6]) + " no ") * n).encode()
        t = time.process_time()
        assert leaks.runs_of(data, a, texts, 12) == []
        took.append(time.process_time() - t)
    assert took[1] < 24 * max(took[0], 0.005)
