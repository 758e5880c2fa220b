"""DuckDB SQL for the text operators, in pieces that mirror kithline.functions.text."""

from __future__ import annotations

from ..functions import text as T

MAX_DF = 0.05


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def fold(c: str) -> str:
    for given, same in T.LIGATURES:
        c = f"replace({c}, {_s(given)}, {_s(same)})"
    return f"lower(strip_accents({c}))"


def mapped(w: str) -> str:
    keys, values = (f"[{', '.join(map(_s, x))}]" for x in (T.TOKEN_MAP, T.TOKEN_MAP.values()))
    return f"coalesce(list_extract({values}, nullif(list_position({keys}, {w}), 0)), {w})"


def strip_zeros(t: str) -> str:
    return f"coalesce(nullif(ltrim({t}, '0'), ''), '0')"


def tokens(c: str, drop: tuple[str, ...] = ()) -> str:
    words = f"list_filter(string_split(regexp_replace(replace({fold(c)}, '&', ' & '), '[^a-z0-9&]+', ' ', 'g'), ' '), lambda w: w <> '')"
    words = f"list_transform({words}, lambda w: case when regexp_matches(w, '^[0-9]+$') then {strip_zeros('w')} else w end)"
    words = f"list_transform({words}, lambda w: {mapped('w')})"
    return f"list_filter({words}, lambda w: w not in ({', '.join(map(_s, drop))}))" if drop else words


def normalized(c: str, drop: tuple[str, ...] = ()) -> str:
    return f"array_to_string({tokens(c, drop)}, ' ')"


def alias(c: str) -> str:
    parts = f"list_filter(regexp_split_to_array({fold(c)}, {_s(T.ALIAS_MARKERS)}), lambda p: trim(p) <> '')"
    return f"case when len({parts}) > 1 then {normalized(f'{parts}[-1]')} else '' end"


def is_domain(c: str) -> str:
    return f"cast(regexp_matches({fold(c)}, {_s(T.DOMAIN_START)}) as int)"


def numbers(c: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({c}, '[0-9]+'), lambda d: {strip_zeros('d')}))), ' ')"


def words(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda w: w <> '')"


def trigrams(c: str) -> str:
    return f"list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3))"


def tagged(tag: str, items: str) -> str:
    return f"list_transform({items}, lambda t: {_s(tag)} || t)"


def weighted(tokens_of: str, max_df: float = 1.0) -> str:
    """TF-IDF rows from a relation (country, entity_id, src, token)."""
    return f"""select country, entity_id, src, token, w / sqrt(sum(w * w) over (partition by country, entity_id)) as w from (
        select tf.country, tf.entity_id, tf.src, tf.token, (1 + ln(c)) * (ln((1 + n) / (1 + df)) + 1) as w from (select country, entity_id, src, token, count(*) as c from {tokens_of} group by 1, 2, 3, 4) tf
        join (select country, token, count(distinct entity_id) as df from {tokens_of} group by 1, 2) d on d.country = tf.country and d.token = tf.token
        join (select country, count(*) as n from raw group by 1) m on m.country = tf.country where df <= {max_df} * n)"""


def dotted(weights: str, name: str) -> str:
    return f"""select rpairs.q, rpairs.s1, coalesce(d, 0) as {name} from rpairs left join (select p.q, p.s1, sum(a.w * b.w) as d from rpairs p join {weights} a on a.entity_id = p.q
        join {weights} b on b.entity_id = p.s1 and a.token = b.token group by p.q, p.s1) x on x.q = rpairs.q and x.s1 = rpairs.s1"""


def margin(c: str) -> str:
    """The value minus the best other of the q (a lone one keeps its value)."""
    return f"{c} - coalesce((select max(o.{c}) from sims o where o.q = sims.q and o.s1 <> sims.s1), 0)"


_words_of = lambda c: f"select country, entity_id, src, unnest({words(c)}) as token from recs"
_chars = f"select country, entity_id, src, unnest(case when length(w) < 3 then [w] else {trigrams('w')} end) as token from (select country, entity_id, src, ' ' || unnest({words('name_n')}) || ' ' as w from recs)"

CTES = {
    "recs": f"""select *, {normalized('business_name')} as name_n, {alias('business_name')} as name_alt, {is_domain('business_name')} as is_domain, {normalized('business_address', T.ADDRESS_FILLERS)} as addr_n,
        {numbers('business_address')} as nums, cast(regexp_matches(business_name, '[^\\x00-\\x7f]') as int) as name_nonascii, cast(trim(business_address) = '' as int) as addr_empty from raw""",
    "generic": f"""select d.country, token from (select country, token, count(*) as df from (select distinct country, entity_id, unnest({words('name_n')}) as token from recs) group by 1, 2) d
        join (select country, count(*) as n from recs group by 1) m on m.country = d.country where df > {MAX_DF} * n""",
    "cores": f"""select *, case when len(core) > 0 then array_to_string(core, ' ') else name_n end as name_core from (
        select *, list_filter(w, lambda x: x <> '&' and not list_contains(coalesce(g, []), x)) as core from (select recs.*, {words('name_n')} as w, g from recs left join (select country, list(token) as g from generic group by country) l on l.country = recs.country))""",
    "bag": f"""select *, list_concat(list_concat(list_concat({tagged('n_', words('name_core'))}, {tagged('n_', words('name_alt'))}), {tagged('c_', trigrams("('#' || name_sq || '#')"))}),
        list_concat({tagged('a_', words('addr_n'))}, {tagged('d_', words('nums'))})) as tokens from (select *, replace(name_core, ' ', '') as name_sq from cores)""",
    "bag_tokens": "select country, entity_id, src, unnest(tokens) as token from bag",
    "weights": weighted("bag_tokens", MAX_DF),
    "sparse": """select q, s1, tfidf, rank from (select *, row_number() over (partition by q order by round(tfidf, 9) desc, s1) as rank from (
        select a.entity_id as q, b.entity_id as s1, sum(a.w * b.w) as tfidf from weights a join weights b on a.country = b.country and a.token = b.token and a.src > 1 and b.src = 1 group by 1, 2) where tfidf > 0.000001) where rank <= 8""",
    "addr_tokens": _words_of("addr_n"), "name_tokens": _words_of("name_n"), "char_tokens": _chars,
    "addr_w": weighted("addr_tokens"), "name_w": weighted("name_tokens"), "char_w": weighted("char_tokens"),
    "addr_idf": dotted("addr_w", "addr_idf"), "name_idf": dotted("name_w", "name_idf"), "name_cidf": dotted("char_w", "name_cidf"),
    "sims": "select a.q, a.s1, addr_idf, name_idf, name_cidf from addr_idf a join name_idf n on n.q = a.q and n.s1 = a.s1 join name_cidf c on c.q = a.q and c.s1 = a.s1",
    "rarity": f"select *, {margin('addr_idf')} as addr_idf_margin, {margin('name_idf')} as name_idf_margin, {margin('name_cidf')} as name_cidf_margin from sims",
    "keyed": "select entity_id, src, country || '|' || array_to_string(list_sort(string_split(name_n, ' ')), ' ') as k from recs",
    "same": """select q, s1, (select count(*) from keyed x join keyed y on y.k = x.k and y.src = 1 where x.entity_id = q) as q_same_name,
        (select count(*) from keyed x join keyed y on y.k = x.k and y.src = 1 where x.entity_id = s1) as s1_same_name from rpairs""",
    "expected": """select q, s1, p, k, ef from (select *, max(ef) over (partition by s1) as top, min(case when ef = m then k end) over (partition by s1) as k_top from (
        select *, max(ef) over (partition by s1) as m from (select o.q, o.s1, o.p, k, 1.25 * cum / (0.25 * e_true + k) as ef, p_none from (
        select *, row_number() over (partition by s1 order by pp desc, q) as k, sum(pp) over (partition by s1 order by pp desc, q rows between unbounded preceding and current row) as cum from (
        select *, row_number() over (partition by q order by pp desc, s1) as rn from sharp) where rn = 1) o
        join (select s1, sum(pp) as e_true, exp(sum(ln(1 - pp))) as p_none from sharp group by s1) t on t.s1 = o.s1))) where top > p_none and k <= k_top""",
    "sharp": "select *, pow(least(greatest(p, cast(0.000001 as double)), 1 - cast(0.000001 as double)), cast(1.5 as double)) as pp from pairs",
}
NEEDS = {
    "recs": "raw", "generic": "recs", "cores": "recs generic", "bag": "cores", "bag_tokens": "bag", "weights": "bag_tokens raw", "sparse": "weights", "addr_tokens": "recs", "name_tokens": "recs", "char_tokens": "recs",
    "addr_w": "addr_tokens", "name_w": "name_tokens", "char_w": "char_tokens", "addr_idf": "rpairs addr_w", "name_idf": "rpairs name_w", "name_cidf": "rpairs char_w", "sims": "addr_idf name_idf name_cidf",
    "rarity": "sims", "keyed": "recs", "same": "keyed rpairs", "sharp": "pairs", "expected": "sharp",
}

#: The default encoder (similarity.hashed_vector) of a column.
def encoder(c: str) -> str:
    text = f"('query: ' || case when trim(coalesce({c}, '')) = '' then '-' else {c} end)"
    code = lambda k, m: f"unicode(substr({text}, i + {k}, 1)) * {m}"
    at = f"list_transform(range(1, length({text}) - 1), lambda i: ({code(0, 7919)} + {code(1, 104729)} + {code(2, 1299709)}) % 9973 % 64)"
    return f"list_transform(range(0, 64), lambda d: cast(len(list_filter({at}, lambda x: x = d)) as double))"


CTES["counted"] = f"select entity_id, src, country, {encoder('name_n')} as cn, {encoder('addr_n')} as ca from recs"
CTES["encoded"] = "select entity_id, src, country, list_transform(cn, lambda x: cast(x / n as float)) as emb_name, list_transform(ca, lambda x: cast(x / a as float)) as emb_addr from (select *, sqrt(list_dot_product(cn, cn)) as n, sqrt(list_dot_product(ca, ca)) as a from counted)"
NEEDS |= {"counted": "recs", "encoded": "counted"}
_sum = lambda a, b: f"list_transform(range(1, len({a}) + 1), lambda i: cast({a}[i] as double) + cast({b}[i] as double))"
_dot = lambda a, b: f"list_dot_product(cast({a} as double[]), cast({b} as double[]))"
DENSE = f"""select q, s1, round(emb, 5) as emb, emb_rank from (select *, row_number() over (partition by q order by round(emb, 9) desc, s1) as emb_rank from (
    select a.entity_id as q, b.entity_id as s1, {_dot('a.v', 'b.v')} / (sqrt({_dot('a.v', 'a.v')}) * sqrt({_dot('b.v', 'b.v')})) as emb
    from (select *, {_sum('emb_name', 'emb_addr')} as v from vectors) a join (select *, {_sum('emb_name', 'emb_addr')} as v from vectors) b on a.country = b.country and a.src > 1 and b.src = 1)) where emb_rank <= 5"""
_VPAIRS = "vectors a join vectors b on b.entity_id = a.entity_id - a.entity_id % 3 where a.src > 1 and b.src = 1"
ROWWISE = f"select a.entity_id as q, b.entity_id as s1, round({_dot('a.emb_name', 'b.emb_name')}, 6) as emb_name, round({_dot('a.emb_addr', 'b.emb_addr')}, 6) as emb_addr from {_VPAIRS}"
COMBINED = f"""select q, s1, round({_dot('x', 'y')} / (sqrt({_dot('x', 'x')}) * sqrt({_dot('y', 'y')}) + cast(0.000001 as double)), 5) as cosine from (
    select a.entity_id as q, b.entity_id as s1, {_sum('a.emb_name', 'a.emb_addr')} as x, {_sum('b.emb_name', 'b.emb_addr')} as y from {_VPAIRS})"""
#: The union of both searches, every pair with both scores and ranks.
CTES["summed"] = f"select entity_id, src, country, {_sum('emb_name', 'emb_addr')} as v from encoded"
CTES["dense"] = f"""select q, s1 from (select *, row_number() over (partition by q order by round(emb, 9) desc, s1) as r from (
    select a.entity_id as q, b.entity_id as s1, {_dot('a.v', 'b.v')} / (sqrt({_dot('a.v', 'a.v')}) * sqrt({_dot('b.v', 'b.v')})) as emb from summed a join summed b on a.country = b.country and a.src > 1 and b.src = 1)) where r <= 5"""
CTES["blocked"] = f"""select p.q, p.s1, coalesce(d, 0) as tfidf, {_dot('a.v', 'b.v')} / (sqrt({_dot('a.v', 'a.v')}) * sqrt({_dot('b.v', 'b.v')}) + cast(0.000001 as double)) as emb
    from (select q, s1 from sparse union select q, s1 from dense) p join summed a on a.entity_id = p.q join summed b on b.entity_id = p.s1
    left join (select p.q, p.s1, sum(x.w * y.w) as d from (select q, s1 from sparse union select q, s1 from dense) p join weights x on x.entity_id = p.q join weights y on y.entity_id = p.s1 and y.token = x.token group by 1, 2) t on t.q = p.q and t.s1 = p.s1"""
NEEDS |= {"summed": "encoded", "dense": "summed", "blocked": "sparse dense summed weights"}
BLOCK = "select q, s1, round(tfidf, 6) as tfidf, row_number() over (partition by q order by round(tfidf, 9) desc, s1) as rank, round(emb, 5) as emb, row_number() over (partition by q order by round(emb, 9) desc, s1) as emb_rank from blocked"
