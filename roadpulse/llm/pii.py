"""Format-preserving pseudonyms for personal data, in native expressions only.

Found and validated: e-mail addresses, IPv4 addresses, phone numbers (an
international + prefix, or the 3-3-4 grouping, also behind a trunk 1), payment cards (13 to 19 digits
that pass the Luhn test), US social security numbers, IBANs (modulo 97),
calendar dates (year-month-day, day-month-year, month-day-year) and secrets
behind a name such as token or password (the whole run of 16 or more letters,
digits and ``_ - . + / =``, without final dots).  Anything that fails its
validation is left alone, but a named secret that is no valid value of another
kind is a secret.

Every value is permuted by a keyed alternating Feistel network of eight
rounds whose round function is SHA-2 over key, kind, round and the other half.
Strings are permuted character by character within their class (digits,
lower, upper), so separators and letter case stay where they are; IPv4
addresses move within 32 bits, social security numbers within their valid
ranges.  Dates of 1800 to 2199 move within the dates of their form (order and
number of digits of day and month), walking on from places that no calendar
has; the forms with two-digit day and month, but for month-first ones, share
one permutation, so 2001-02-03 and 03/02/2001 stay linked.  Check digits are
computed anew.  A network is a permutation, so different values of a kind and
form never meet, and equal values stay equal in every document.

What stays in clear: an e-mail's domain (``John@`` and ``john@`` are different
values, as case is kept), a phone's country prefix or trunk 1 and an IBAN's
country.  Card and phone numbers that differ only in separators are one value,
as long as a phone's prefix is set off in all or none.  Not looked for:
national phone formats other than 3-3-4, IPv6, dates with month names, and
secrets without a name before them.

Edge cases: a null text stays null with no values.  Null ids are kept.
Repeated rows stay.  An empty table gives no rows.  Other columns pass through
``pseudonymize``; its working column is named ``_pii``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Kind -> pattern, in order of preference at one position.  Group 1 is a named secret.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,126}[A-Za-z]{2,24}"
             r"(?![A-Za-z0-9-])",
    "secret": r"(?<=(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Kk]ey|KEY|[Pp]assword|PASSWORD)"
              r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?)([A-Za-z0-9_+/-][A-Za-z0-9_+/=.-]{14,}[A-Za-z0-9_+/=-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "date": r"(?<![\d./-])(?:\d{4}([-/.])\d{2}\2\d{2}|\d{1,2}([-/.])\d{1,2}\3\d{4})(?![-/.]?\d)",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?!-?\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\4\d{4}\4\d{1,7}|\d{4}([ -])\d{6}\5\d{5})(?!\d)",
    "phone": r"(?:(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}"
             r"|(?<![\d+(.-])(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4})(?![\d])",
}
_ANY = "|".join(KINDS.values())


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _is(kind: str, value: str = "v") -> str:
    """Whether the whole of ``value`` has the form of ``kind``."""
    pattern = KINDS[kind]
    for group in ("\\4", "\\5"):  # a lone pattern numbers its own groups
        pattern = pattern.replace(group, "\\1" if group == "\\4" else "\\2")
    if kind == "date":
        pattern = r"(?:\d{4}([-/.])\d{2}\1\d{2}|\d{1,2}([-/.])\d{1,2}\2\d{4})"
    return f"{value} rlike {_text('^(?:' + pattern + ')$')}"


def _bits(key: str, kind: str, round_: str, other: str, size: int) -> str:
    """Hex digits; ``kind`` is a SQL expression."""
    return f"sha2(concat_ws('|', {_text(key)}, {kind}, {round_}, {other}), {size})"


def _numbers(key: str, kind: str, a: int | str, b: int | str, left: str, right: str, kind_of: str | None = None) -> str:
    """Feistel permutation of Z_a x Z_b; gives struct(l, r)."""
    bits = lambda other: _bits(key, kind_of or f"'{kind}'", "n", other, 256)
    turn = lambda other: f"cast(conv(substr({bits(other)}, 1, 15), 16, 10) as bigint)"
    return (f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), "
            f"(h, n) -> if(n % 2 = 0, named_struct('l', (h.l + {turn('h.r')} % {a}) % {a}, 'r', h.r), "
            f"named_struct('l', h.l, 'r', (h.r + {turn('h.l')} % {b}) % {b})))")


def _string(key: str, kind: str, value: str) -> str:
    """Feistel permutation of a string: characters move within digits, lower or upper case letters."""
    def turned(half: str, other: str) -> str:
        pad = _bits(key, f"'{kind}'", "i, length(s.l), length(s.r)", other, 512)
        step = "cast(conv(substr(pad, 2 * (k % 64) + 1, 2), 16, 10) as int)"
        moved = " ".join(f"when c between '{lo}' and '{hi}' then chr({ord(lo)} + (ascii(c) - {ord(lo)} + {step}) % {n})"
                         for lo, hi, n in (("0", "9", 10), ("a", "z", 26), ("A", "Z", 26)))
        # the pad is bound once, as the only element of an array
        return (f"transform(array({pad}), pad -> array_join(transform(split({half}, ''), "
                f"(c, k) -> case {moved} else c end), ''))[0]")
    cut = f"cast(length({value}) div 2 as int)"
    return (f"transform(array(aggregate(sequence(0, {ROUNDS - 1}), "
            f"named_struct('l', substr({value}, 1, {cut}), 'r', substr({value}, {cut} + 1)), "
            f"(s, i) -> if(i % 2 = 0, named_struct('l', {turned('s.l', 's.r')}, 'r', s.r), "
            f"named_struct('l', s.l, 'r', {turned('s.r', 's.l')})))), z -> concat(z.l, z.r))[0]")


def _filled(form: str, new: str, kept: str = "[0-9A-Za-z]") -> str:
    """``form`` with its letters and digits replaced in order by those of ``new``."""
    return (f"aggregate(split({form}, ''), named_struct('o', '', 'n', 0), (f, c) -> "
            f"if(c rlike '^{kept}$', named_struct('o', concat(f.o, substr({new}, f.n + 1, 1)), 'n', f.n + 1), "
            f"named_struct('o', concat(f.o, c), 'n', f.n)), f -> f.o)")


def _luhn(digits: str) -> str:
    """Sum that the check digit brings to a multiple of ten; ``digits`` end before that digit."""
    d = f"(ascii(substr({digits}, p, 1)) - 48)"
    return (f"aggregate(sequence(1, length({digits})), 0, (t, p) -> t + if((length({digits}) - p) % 2 = 0, "
            f"if({d} > 4, 2 * {d} - 9, 2 * {d}), {d}))")


def _mod97(chars: str) -> str:
    """Letters-and-digits string modulo 97, letters as 10 to 35."""
    return (f"aggregate(split({chars}, ''), 0, (t, c) -> if(c between '0' and '9', (t * 10 + ascii(c) - 48) % 97, "
            f"(t * 100 + ascii(c) - 55) % 97))")


WALK = 24  # steps after which a date's walk ends; a step fails for at most one place in thirty


def _date(key: str) -> str:
    """(new text, null if no calendar date from 1800 to 2199) in the form of ``v``: order, separator, lengths.

    The form's dates are permuted among themselves: years by places of month
    and day, walking on from places that no calendar has (30 February).  A
    date is read day first if its second number can be a month, so the days of
    a month-first date stay above 12 and its pseudonym reads month first too.
    """
    bind = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    number = lambda part: f"cast({part} as bigint)"
    named = lambda order, y, m, d: f"named_struct('o', '{order}', 'y', {number(y)}, 'm', {number(m)}, 'd', {number(d)}, 'ml', length({m}), 'dl', length({d}))"
    read = (f"case when length(p[0]) = 4 then {named('ymd', 'p[0]', 'p[1]', 'p[2]')} "
            f"when cast(p[1] as int) <= 12 then {named('dmy', 'p[2]', 'p[1]', 'p[0]')} "
            f"when v not like '%.%' then {named('mdy', 'p[2]', 'p[0]', 'p[1]')} end")
    leap = lambda y: f"({y} % 4 = 0 and ({y} % 100 <> 0 or {y} % 400 = 0))"
    real = lambda y, m, d: (f"({y} between 1800 and 2199 and {m} between 1 and 12 and {d} between 1 and "  # noqa: E731
                            f"case when {m} in (4, 6, 9, 11) then 30 when {m} <> 2 then 31 when {leap(y)} then 29 else 28 end)")
    # months and days of the form: one digit, two digits, or month-first days
    form = ("named_struct('months', if(q.ml = 1, 9, 12), 'days', case when q.o = 'mdy' then 19 when q.dl = 1 then 9 else 31 end, "
            "'first', if(q.o = 'mdy', 13, 1))")
    turned = _numbers(key, "date", "400", "(w.months * w.days)", "s.y - 1800", "(s.m - 1) * w.days + s.d - w.first",
                      "concat('date', w.months, '-', w.days)")
    step = bind(turned, "z", "named_struct('y', z.l + 1800, 'm', z.r div w.days + 1, 'd', z.r % w.days + w.first)")
    walked = (f"aggregate(sequence(1, {WALK}), named_struct('y', q.y, 'm', q.m, 'd', q.d, 'ok', false), (s, i) -> if(s.ok, s, "
              + bind(step, "x", f"named_struct('y', x.y, 'm', x.m, 'd', x.d, 'ok', {real('x.y', 'x.m', 'x.d')})") + "))")
    two = lambda x, n: f"lpad({x}, {n}, '0')"
    printed = (f"case q.o when 'ymd' then concat_ws(c, x.y, {two('x.m', 2)}, {two('x.d', 2)}) "
               f"when 'dmy' then concat_ws(c, {two('x.d', 'q.dl')}, {two('x.m', 'q.ml')}, x.y) "
               f"else concat_ws(c, {two('x.m', 'q.ml')}, {two('x.d', 'q.dl')}, x.y) end")
    whole = bind(form, "w", bind(walked, "x", bind("regexp_extract(v, '[-/.]', 0)", "c", printed)))
    return bind("split(v, '[-/.]')", "p", bind(read, "q", f"if(q is null or not {real('q.y', 'q.m', 'q.d')}, null, {whole})"))


def replacement(key: str) -> str:
    """SQL over a found value ``v`` (``m.named``: found as a secret): struct(kind, new), kind null if it is not valid."""
    digits, plain = r"regexp_replace(v, '[^0-9]', '')", "regexp_replace(v, '[^0-9A-Z]', '')"
    bind = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    octet = lambda part: f"cast(element_at(split(v, '[.]'), {part}) as bigint)"
    ip = bind(_numbers(key, "ip", 65536, 65536, f"{octet(1)} * 256 + {octet(2)}", f"{octet(3)} * 256 + {octet(4)}"), "z",
              "concat_ws('.', z.l div 256, z.l % 256, z.r div 256, z.r % 256)")
    # areas 001-665 and 667-899, groups 01-99, serials 0001-9999
    area = "cast(substr(v, 1, 3) as bigint)"
    ssn = bind(_numbers(key, "ssn", 898 * 99, 9999,
                        f"({area} - if({area} > 666, 2, 1)) * 99 + cast(substr(v, 5, 2) as bigint) - 1",
                        "cast(substr(v, 8, 4) as bigint) - 1"), "z",
               "concat(lpad(z.l div 99 + if(z.l div 99 >= 665, 2, 1), 3, '0'), '-', lpad(z.l % 99 + 1, 2, '0'), '-', "
               "lpad(z.r + 1, 4, '0'))")
    check = lambda body: f"(10 - {_luhn(body)} % 10) % 10"
    body = "substr(d, 1, length(d) - 1)"
    card = bind(digits, "d", bind(_string(key, "card", body), "w", _filled("v", f"concat(w, {check('w')})")))
    card_ok = bind(digits, "d", f"cast(substr(d, -1) as int) = {check(body)}")
    prefix = r"regexp_extract(v, '^[+][0-9]{1,3}', 0)"
    # without separators the prefix's own length cannot be told: the first digit alone is kept
    kept = f"if({prefix} = '', regexp_extract(v, '^1[ .-]', 0), if(v rlike '^[+][0-9]+$', substr(v, 1, 2), {prefix}))"
    phone = bind(kept, "q", bind("substr(v, length(q) + 1)", "t", bind(
        _string(key, "phone", r"regexp_replace(t, '[^0-9]', '')"), "w", f"concat(q, {_filled('t', 'w')})")))
    iban = bind(plain, "d", bind(_string(key, "iban", "substr(d, 5)"), "w", _filled(
        "v", f"concat(substr(d, 1, 2), lpad(98 - {_mod97('concat(w, substr(d, 1, 2), chr(48), chr(48))')}, 2, '0'), w)")))
    iban_ok = bind(plain, "d", f"length(d) between 15 and 34 and {_mod97('concat(substr(d, 5), substr(d, 1, 4))')} = 1")
    local = bind("substring_index(v, '@', 1)", "m", f"concat({_string(key, 'email', 'm')}, '@', substring_index(v, '@', -1))")
    made = lambda kind, new: f"named_struct('kind', '{kind}', 'new', {new})"
    none = "named_struct('kind', cast(null as string), 'new', v)"
    return (f"case when {_is('email')} then {made('email', local)} "
            f"when {_is('ip')} then {made('ip', ip)} "
            f"when {_is('date')} then {bind(_date(key), 'x', f'if(x is null, {none}, ' + made('date', 'x') + ')')} "
            f"when {_is('ssn')} then {made('ssn', ssn)} "
            f"when {_is('card')} and {card_ok} then {made('card', card)} "
            f"when {_is('phone')} and length({digits}) between 8 and 15 then {made('phone', phone)} "
            f"when {_is('iban')} and {iban_ok} then {made('iban', iban)} "
            f"when m.named then {made('secret', _string(key, 'secret', 'v'))} "
            f"else {none} end")


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col`` and ``_pii``, the kinds replaced in order of place."""
    name = "`" + text_col.replace("`", "``") + "`"
    names = "[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Kk]ey|KEY|[Pp]assword|PASSWORD"
    every = lambda group: f"regexp_extract_all({name}, {_text(_ANY)}, {group})"
    # which of the values were found as secrets is asked only where a name is followed by one
    secrets = f"if({name} rlike {_text(f'(?:{names})' + "[\"\']?\\s{0,3}[:=]")}, {every(1)}, cast(array() as array<string>))"
    matches = f"if({name} rlike '[0-9@]|{names}', transform(array({secrets}), s -> transform({every(0)}, (v, i) -> " \
              "named_struct('v', v, 'named', coalesce(get(s, i), '') <> '')))[0], " \
              "cast(array() as array<struct<v: string, named: boolean>>))"
    found = docs.withColumn("_pii", F.expr(matches))
    found = found.withColumn("_pii", F.expr(f"transform(_pii, m -> transform(array(m.v), v -> {replacement(key)})[0])"))
    text = (f"if(exists(_pii, m -> m.kind is not null), array_join(flatten(zip_with(split({name}, {_text(_ANY)}, -1), _pii, "
            f"(p, m) -> array(p, coalesce(m.new, '')))), ''), {name})")
    return found.withColumns({text_col: F.expr(text), "_pii": F.expr(
        "transform(filter(_pii, m -> m.kind is not null), m -> m.kind)")})


#: A stand-in for a secret from the caller's vault; only the registered query uses it.
DEMO_KEY = "demonstration key"


def op9_pii_pseudonyms(spark, sf_dir):
    """Pseudonyms in all ``documents``: the new text and the kinds found."""
    from .common import table
    done = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    return done.select("doc_id", F.size(F.coalesce("_pii", F.array())).cast("long").alias("n_values"),
                       F.array_join(F.array_sort(F.array_distinct("_pii")), ",").alias("kinds"), "text")
