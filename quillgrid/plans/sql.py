"""Pieces of DuckDB SQL that the oracles share."""


def norm(e: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({e}, '')), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def tokens(e: str) -> str:
    return f"list_filter(string_split({norm(e)}, ' '), lambda t: length(t) >= 2)"


def unique(e: str) -> str:
    """A list's items by first occurrence; e is a column."""
    return f"list_filter({e}, lambda t, i: list_position({e}, t) = i)"


def runs(e: str, size: int, glue: str = " ") -> str:
    """Runs of neighbours; e is a column. Shifted slices are zipped."""
    n = f"greatest(len({e}) - {size - 1}, 0)"
    slices = ", ".join(f"{e}[{k + 1}:{n} + {k}]" for k in range(size))
    joined = f" || '{glue}' || ".join(f"p[{k + 1}]" for k in range(size))
    return f"list_transform(list_zip({slices}), lambda p: {joined})"


def first_tokens(table: str, id: str, column: str) -> str:
    """Common tables tk_ and u: each row's distinct tokens (u.u) by first occurrence, from a list column."""
    return f"""tk_ as (select {id}, unnest({column}) as term, generate_subscripts({column}, 1) as pos from {table}), tm_ as (select {id}, term, min(pos) as pos from tk_ group by all),
ul_ as (select {id}, list(term order by pos) as u from tm_ group by all), u as (select {table}.{id}, coalesce(ul_.u, cast([] as varchar[])) as u from {table} left join ul_ using ({id}))"""


def strings(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]" if items else "cast([] as varchar[])"


def cover(items, e: str) -> str:
    """Share of the items that a text contains."""
    return f"len(list_filter({strings(items)}, lambda x: contains({e}, x))) / {len(items)}.0" if items else "0.0"


def _fnv(e: str, start: str = "2166136261::ubigint") -> str:
    return f"list_reduce(list_prepend({start}, list_transform(string_split({e}, ''), lambda c: cast(unicode(c) as ubigint))), lambda h, c: (xor(h, c) * 16777619::ubigint) % 4294967296::ubigint)"


def _then(h: str, code: str) -> str:
    return f"((xor({h}, cast({code} as ubigint)) * 16777619::ubigint) % 4294967296::ubigint)"


def grams(c: str) -> str:
    """n-grams of 3 to 5 characters of a column of characters."""
    return f"list_concat({runs(c, 3, '')}, {runs(c, 4, '')}, {runs(c, 5, '')})"


def dense(p: str, source: str, dims: int) -> str:
    """Common tables up to {p}v (id, bucket, value): hashed projections at length 1 of a table's (id, n) normalised texts without Hangul."""
    many = min(6, max(3, -(-dims // 128)))
    u, v = _then(_then("h", "58"), "48 + i"), _then(_then("s", "58"), "48 + i")
    return f"""{p}t as (select id, n, replace(n, ' ', '') as c, list_filter(string_split(n, ' '), lambda t: length(t) >= 2) as t, string_split(replace(n, ' ', ''), '') as ch from {source} where n <> ''),
{p}f as (select id, f, sum(w) as w from (select id, 'tok:' || t as f, 1 + ln(1 + count(*)) as w from (select id, unnest(t) as t from {p}t) group by id, t
 union all select id, 'phrase:' || unnest(list_concat({runs('t', 2)}, {runs('t', 3)})), 1.3 from {p}t
 union all select id, 'sem:' || s, case when contains(s, ' ') then 1.25 else 1.05 end from (select id, unnest(t) as s from {p}t union select id, n from {p}t)
 union all select id, 'char:' || unnest({grams('ch')}), 0.28 from {p}t
 union all select id, 'full:' || c, 1.45 from {p}t) group by all),
{p}h as (select f, {_fnv('f')} as h, {_fnv("('sign:' || f)")} as s from (select distinct f from {p}f)),
{p}p as (select f, i, cast({u} as bigint) as h, cast({v} as bigint) as s from {p}h, (select unnest(range({many})) as i)),
{p}b as (select id, bucket, sum(x) as x from (select id, least(h, 4294967296 - h) % {dims} as bucket, w * case when s % 2 = 1 then 1.0 else -1.0 end / case when i = 0 then 1.0 else i + 0.5 end as x from {p}f join {p}p using (f)
 union all select id, 1, 0.03 * length(regexp_replace(n, '[^a-z]', '', 'g')) from {p}t) group by all),
{p}v as (select id, bucket, round(x / size, 6) as value from {p}b join (select id, sqrt(sum(x * x)) as size from {p}b group by id) using (id) where size > 0 and round(x / size, 6) <> 0)"""


def sparse20(p: str, source: str) -> str:
    """Common table {p}s (id, term, w): twenty times the sparse weights of a table's (id, n) normalised texts without Hangul."""
    return f"""{p}st as (select id, list_filter(string_split(n, ' '), lambda t: length(t) >= 2) as t, string_split(replace(n, ' ', ''), '') as ch from {source}),
{p}s as (select id, term, cast(sum(w) as bigint) as w from (select id, unnest(t) as term, 20 as w from {p}st union all select id, unnest({runs('t', 2)}), 35 from {p}st union all select id, unnest({runs('t', 3)}), 44 from {p}st
 union all select id, 'char:' || unnest({grams('ch')}), 4 from {p}st where len(ch) >= 4) group by all)"""


def passages(p: str, source: str, most: int) -> str:
    """Common tables up to {p} (id, ord, label, passage): a table's (id, n, label, raw) texts, n ordering the labels, as sentences packed into passages of at most so many characters."""
    whole = f"a.c <> '' and length(a.c) + 1 + length(b.c) <= {most}"
    fold = f"""list_reduce(list_transform(string_split(regexp_replace(sq, '([.!?다요])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {{'c': s, 'o': cast([] as varchar[])}}),
 lambda a, b: case when {whole} then {{'c': a.c || ' ' || b.c, 'o': a.o}} when length(b.c) <= {most} then {{'c': b.c, 'o': list_append(a.o, a.c)}}
 else {{'c': '', 'o': list_concat(a.o, [a.c], list_transform(range(0, length(b.c), {most}), lambda i: trim(b.c[i + 1:i + {most}])))}} end, {{'c': '', 'o': cast([] as varchar[])}})"""
    return f"""{p}0 as (select id, n, label, trim(regexp_replace(coalesce(raw, ''), '\\s+', ' ', 'g')) as sq from {source}),
{p}1 as (select id, n, label, case when length(sq) <= {most} then {{'c': sq, 'o': cast([] as varchar[])}} else {fold} end as f from {p}0),
{p}2 as (select id, n, label, unnest(list_append(f.o, f.c)) as passage, generate_subscripts(list_append(f.o, f.c), 1) as k from {p}1),
{p} as (select id, label, passage, cast(row_number() over (partition by id order by min(n), min(k)) as int) as ord from {p}2 where passage <> '' group by id, label, passage)"""
