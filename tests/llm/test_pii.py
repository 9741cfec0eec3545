import datetime
import hashlib
import re

from pyspark.sql import functions as F

from roadpulse.llm import pii

ROWS = [
    (1, "card 4026083977531332, and 4026-0839-7753-1332 or 4026 0839 7753 1332."), (2, "not a card 9807915762804490"),
    (3, "mail und.34@mail7.example. and a@b, x@y.z"), (4, "+1 (017) 555-7713 and +1 017 555 7713"), (5, "(212) 555-1234 212-555-1234"),
    (6, "ip 97.51.17.173. 256.1.1.1 1.2.3.4.5"), (7, "2020-02-29 2021-02-29 29.02.2020 29/02/2020 12/25/2020 2020/02/29"),
    (8, "ssn 123-45-6789 000-12-1234 666-12-1234"), (9, "DE89 3704 0044 0532 0130 00 DE89370400440532013000 DE88370400440532013000"),
    (10, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" hash 04dbebab91ab85687d33eeaaf9ac699e1188f962'), (11, None), (12, ""),
    (13, "v1.2.3 12345 3.14 7-8 1999 100.000.000"), (None, "4026083977531332"), (1, "card 4026083977531332, and 4026-0839-7753-1332 or 4026 0839 7753 1332."),
    (14, "x " * 60000 + "97.51.17.173"), (15, "7536784127813050 4845168114407329"), (16, "$1 \\1 ${a} '97.51.17.173' \"q\"")]


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(d[0::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def table(spark):
    return spark.createDataFrame([(k, t, "m", "v", 1) for k, t in ROWS], "doc_id long, text string, kind string, v string, d long")


def test_values_are_replaced_within_their_format(spark):
    got = {}
    for r in pii.pseudonymize(table(spark), "key").collect():
        got.setdefault(r.doc_id, []).append(r)
    text = {k: v[0].text for k, v in got.items()}
    a, b, c = re.findall(r"\d{16}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{4} \d{4} \d{4}", text[1])
    assert luhn(a) and a == b.replace("-", "") == c.replace(" ", "") != "4026083977531332"
    assert len(got[1]) == 2 and got[1][0].text == got[1][1].text and text[None] == a
    assert text[2] == ROWS[1][1] and text[13] == ROWS[12][1] and text[11] is None and text[12] == ""
    assert re.fullmatch(r"mail [a-z]{3}\.\d\d@mail7\.example\. and a@b, x@y\.z", text[3]) and "und.34" not in text[3]
    one, two = text[4].split(" and ")
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", one) and re.sub(r"\D", "", one) == re.sub(r"\D", "", two)
    one, two = re.findall(r"\(\d{3}\) \d{3}-\d{4}|\d{3}-\d{3}-\d{4}", text[5])
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two) != "2125551234"
    assert text[6].endswith(" 256.1.1.1 1.2.3.4.5") and "97.51.17.173" not in text[6]
    d = text[7].split()
    assert datetime.date.fromisoformat(d[0]) != datetime.date(2020, 2, 29) and d[1] == "2021-02-29"
    assert datetime.datetime.strptime(d[2], "%d.%m.%Y") == datetime.datetime.strptime(d[0], "%Y-%m-%d")
    assert d[5] == d[0].replace("-", "/") and datetime.datetime.strptime(d[4], "%m/%d/%Y")
    s = text[8].split()
    assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", s[1]) and s[1] != "123-45-6789" and s[2:] == ["000-12-1234", "666-12-1234"]
    iban = re.findall(r"DE\d\d(?: \d{4}){4} \d\d|DE\d{20}", text[9])
    assert iban[0].replace(" ", "") == iban[1] != "DE89370400440532013000" and iban[2] == "DE88370400440532013000"
    assert int("".join(str(int(c, 36)) for c in iban[1][4:] + iban[1][:4])) % 97 == 1
    assert text[10].endswith("hash 04dbebab91ab85687d33eeaaf9ac699e1188f962") and text[10].count("04dbebab") == 1
    assert text[14].startswith("x " * 60000) and not text[14].endswith("97.51.17.173")
    left, right = text[15].split()
    assert luhn(left) and luhn(right)
    assert re.fullmatch(r"\$1 \\1 \$\{a\} '[\d.]+' \"q\"", text[16])
    assert [r._pii for r in got[7]] == [["date"] * 5] and [r._pii for r in got[2]] == [[]]
    assert pii.pseudonymize(table(spark).limit(0), "key").count() == 0


def test_keyed_and_one_to_one(spark):
    """Every date of some years, and all last groups of a phone number, map to different values; another key, another map."""
    days = [(datetime.date(1999, 1, 1) + datetime.timedelta(k)).isoformat() for k in range(1500)]
    phones = [f"212-555-{k:04d}" for k in range(1500)]
    frame = spark.createDataFrame([(d, p) for d, p in zip(days, phones)], "d string, p string")

    def mapped(key, column):
        return {r[0]: r[1] for r in pii.pseudonymize(frame.select(column, frame[column].alias("text")), key).select(column, "text").collect()}
    for column in ("d", "p"):
        one, two = mapped("a", column), mapped("b", column)
        assert len(set(one.values())) == 1500 and one == mapped("a", column)
        assert sum(one[k] == two[k] for k in one) < 15


def test_network_is_a_permutation_of_a_whole_small_domain(spark):
    frame = spark.range(6 * 35).selectExpr("id div 35 as x", "id % 35 as y")
    got = frame.selectExpr(pii._numbers("k", "t", 6, 35, "x", "y") + " as z").select("z.l", "z.r").distinct()
    assert got.count() == 210 and got.where("l between 0 and 5 and r between 0 and 34").count() == 210


def test_query_changes_only_values(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    changed = 0
    for r in pii.op9_pii_pseudonyms(spark, sf).collect():
        if r.n_values == 0:
            assert r.text == docs[r.doc_id]
        else:
            changed += 1
            shape = lambda t: re.sub(r"\d+", "9", re.sub(r"[a-z]", "a", t))
            assert shape(r.text) == shape(docs[r.doc_id]) and r.text != docs[r.doc_id]
            for card in re.findall(r"(?<!\d)\d{16}(?!\d)", docs[r.doc_id]):
                assert (card in r.text) == (not luhn(card))
    assert changed


def test_short_groups_trunk_prefixes_and_whole_secrets(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    values = ["+33 1 23 45 67 89", "+61 2 9374 4000", "+353 1 234 5678", "+46 8 123 456 78", "1-212-555-1234", "1.212.555.1234",
              "1 (212) 555-1234"]
    secrets = ["a1B2c3D4" * 40, jwt, "q1w2+e3r4/t5y6u7i8==", "9807915762804490", "AB12CDEFGHIJKLMNOP"]
    rows = [(k, f"x {v}.") for k, v in enumerate(values)] + [(100 + k, f'token = "{v}" {k}') for k, v in enumerate(secrets)]
    rows += [(200, f"token: {jwt}."), (201, "9807915762804490 AB12CDEFGHIJKLMNOP token"), (202, "key=212-555-1234 and 9807915762804490")]
    got = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    shape = lambda t: re.sub(r"\d", "9", re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", t)))
    for k, text in rows[:-2]:
        assert got[k]._pii == ["phone" if k < 100 else "secret"] and shape(got[k].text) == shape(text)
        assert got[k].text != text and not set(re.findall(r"\w{8,}", text)) & set(re.findall(r"\w{8,}", got[k].text))
    assert got[201].text == rows[-2][1] and got[202]._pii == ["phone"]
    last = [re.sub(r"\D", "", got[k].text) for k in (4, 5, 6)]
    assert len(set(last)) == 1 and last[0][0] == "1" and got[0].text.startswith("x +33 ")
    assert got[200].text[7:-1] == got[101].text.split('"')[1]


# --- a second implementation: the same networks over the same kinds, in plain Python -------------------------

def py_bits(key, kind, rest, size):
    return hashlib.new(f"sha{size}", "|".join([key, kind, *map(str, rest)]).encode()).hexdigest()


def py_numbers(key, kind, a, b, left, right):
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + int(py_bits(key, kind, [i, right], 256)[:15], 16) % a) % a
        else:
            right = (right + int(py_bits(key, kind, [i, left], 256)[:15], 16) % b) % b
    return left, right


def py_string(key, kind, value):
    left, right = value[:len(value) // 2], value[len(value) // 2:]

    def turned(half, other, i, lengths):
        pad, out = py_bits(key, kind, [i, *lengths, other], 512), ""
        for k, c in enumerate(half):
            step = int(pad[2 * (k % 64):2 * (k % 64) + 2], 16)
            for lo, n in (("0", 10), ("a", 26), ("A", 26)):
                if ord(lo) <= ord(c) < ord(lo) + n:
                    c = chr(ord(lo) + (ord(c) - ord(lo) + step) % n)
                    break
            out += c
        return out
    for i in range(pii.ROUNDS):
        lengths = (len(left), len(right))
        if i % 2 == 0:
            left = turned(left, right, i, lengths)
        else:
            right = turned(right, left, i, lengths)
    return left + right


def py_filled(form, new):
    new = iter(new)
    return "".join(next(new) if re.match("[0-9A-Za-z]", c) else c for c in form)


def py_check_digit(body):
    return next(c for c in "0123456789" if luhn(body + c))


def py_date(key, v):
    sep = re.search("[-/.]", v)[0]
    p = v.split(sep)
    if len(p[0]) == 4:
        order, (y, m, d) = "ymd", p
    elif int(p[1]) <= 12:
        order, (d, m, y) = "dmy", p
    elif sep != ".":
        order, (m, d, y) = "mdy", p
    else:
        return None

    def real(y, m, d):
        try:
            datetime.date(y, m, d)
        except ValueError:
            return False
        return 1800 <= y <= 2199
    if not real(int(y), int(m), int(d)):
        return None
    months, days, first = 9 if len(m) == 1 else 12, 19 if order == "mdy" else 9 if len(d) == 1 else 31, 13 if order == "mdy" else 1
    at = (int(y), int(m), int(d))
    while True:
        a, b = py_numbers(key, f"date{months}-{days}", 400, months * days, at[0] - 1800, (at[1] - 1) * days + at[2] - first)
        at = (a + 1800, b // days + 1, b % days + first)
        if real(*at):
            break
    m, d = str(at[1]).zfill(len(m)), str(at[2]).zfill(len(d))
    return sep.join({"ymd": [str(at[0]), m, d], "dmy": [d, m, str(at[0])], "mdy": [m, d, str(at[0])]}[order])


def py_value(key, v, named):
    """(kind or None, new value) of one found value."""
    whole = lambda kind: re.fullmatch(alone(kind), v, re.A)
    digits, plain = re.sub("[^0-9]", "", v), re.sub("[^0-9A-Z]", "", v)
    mod97 = lambda s: int("".join(str(int(c, 36)) for c in s)) % 97
    if whole("email"):
        local, domain = v.split("@", 1)
        return "email", py_string(key, "email", local) + "@" + domain
    if whole("ip"):
        a, b, c, d = map(int, v.split("."))
        left, right = py_numbers(key, "ip", 65536, 65536, a * 256 + b, c * 256 + d)
        return "ip", ".".join(map(str, (*divmod(left, 256), *divmod(right, 256))))
    if whole("date"):
        new = py_date(key, v)
        return ("date", new) if new else (None, v)
    if whole("ssn"):
        area, group, serial = map(int, v.split("-"))
        left, right = py_numbers(key, "ssn", 898 * 99, 9999, (area - (2 if area > 666 else 1)) * 99 + group - 1, serial - 1)
        area, group = left // 99 + (2 if left // 99 >= 665 else 1), left % 99 + 1
        return "ssn", f"{area:03d}-{group:02d}-{right + 1:04d}"
    if whole("card") and luhn(digits):
        body = py_string(key, "card", digits[:-1])
        return "card", py_filled(v, body + py_check_digit(body))
    if whole("phone") and 8 <= len(digits) <= 15:
        prefix = re.match(r"[+][0-9]{1,3}", v)
        kept = (v[:2] if re.fullmatch("[+][0-9]+", v) else prefix[0]) if prefix else (re.match("1[ .-]", v) or [""])[0]
        rest = v[len(kept):]
        return "phone", kept + py_filled(rest, py_string(key, "phone", re.sub("[^0-9]", "", rest)))
    if whole("iban") and 15 <= len(plain) <= 34 and mod97(plain[4:] + plain[:4]) == 1:
        body = py_string(key, "iban", plain[4:])
        return "iban", py_filled(v, f"{plain[:2]}{98 - mod97(body + plain[:2] + '00'):02d}{body}")
    if named:
        return "secret", py_string(key, "secret", v)
    return None, v


def alone(kind):
    """A kind's pattern with its own group numbers."""
    numbers = {"date": [r"\2", r"\3"], "card": [r"\4", r"\5"]}.get(kind, [])
    pattern = pii.KINDS[kind]
    for i, old in enumerate(numbers):
        pattern = pattern.replace(old, rf"(?:\{i + 1})")
    return pattern


def py_text(key, text):
    """Kinds and new text; the engine's lookbehind of several lengths becomes a look at what precedes a match."""
    import regex
    kinds, out, at = [], [], 0
    for m in regex.finditer("|".join(pii.KINDS.values()), text or "", regex.A):
        kind, new = py_value(key, m[0], m[1] is not None)
        kinds += [kind] if kind else []
        out += [text[at:m.start()], new]
        at = m.end()
    return kinds, None if text is None else "".join(out) + text[at:]


def test_second_implementation_agrees_on_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10_000 + k, t) for k, (_, t) in enumerate(ROWS)] + [
        (20_000 + k, t) for k, t in enumerate(["1.2.2000 01.2.2000 1.02.2000 12/25/1999 1/25/1999 25/1/1999 31.4.2000 29.02.1900 13/13/2000",
                                               "a.b@c.example.org +442071234567 +49 30 123456 token: " + "Ab3" * 50])], "doc_id long, text string")
    docs = docs.unionByName(more)
    want = {r.doc_id: py_text("key", r.text) for r in docs.collect()}
    found = 0
    for r in pii.pseudonymize(docs, "key").collect():
        kinds, text = want[r.doc_id]
        assert (r._pii or []) == kinds and r.text == text, r.doc_id
        found += len(kinds)
    assert found > 50


def test_different_dates_never_share_a_pseudonym(spark):
    """All days of the 400 years in all forms: one pseudonym for each date written, in the same form."""
    form = {"iso": "yyyy-MM-dd", "dmy": "dd-MM-yyyy", "dmy1": "d-M-yyyy", "mdy": "MM-dd-yyyy", "mdy1": "M-d-yyyy"}
    days = spark.range(146_097).selectExpr("date_add(date'1800-01-01', cast(id as int)) as day")
    parts = [days.selectExpr(f"'{k}' as form", f"date_format(day, '{p}') as was", "day").where("day(day) > 12" if k[0] == "m" else "true")
             for k, p in form.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.repartition(8).selectExpr("form", "day", "was", "was as text")
    got = pii.pseudonymize(every, "key").selectExpr("day", "was", "text", "size(_pii) as n", "regexp_replace(was, '[0-9]', '9') as shape")
    got = got.groupBy("text").agg(F.count_distinct("was").alias("was"), F.count_distinct("day").alias("days"), F.min("n").alias("n"),
                                  F.bool_and(F.col("shape") == F.regexp_replace("text", "[0-9]", "9")).alias("same"))
    row = got.agg(F.max("was").alias("was"), F.max("days").alias("days"), F.min("n").alias("n"), F.bool_and("same").alias("same")).first()
    assert tuple(row) == (1, 1, 1, True)


def test_long_texts_that_look_like_mail(spark):
    texts = ["x@" + "a." * 500_000, "x@" + "a" * 1_000_000, "a." * 500_000 + "@b.example.org", "1." * 300_000, "+1 " * 300_000,
             "token=" + "a" * 1_000_000]
    rows = pii.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "key").collect()
    assert [len(r.text) for r in rows] == [len(t) for t in texts]
