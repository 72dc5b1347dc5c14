"""DuckDB SQL for the operators' queries that SQL can express, over whole tables."""

from __future__ import annotations

from tidemark.llm.decontam import SLOP
from tidemark.llm.license_scan import TEMPLATES, THRESHOLD
from tidemark.llm.quality_rules import RULES, STOP_WORDS, Rule
from tidemark.llm.url_filter import TreeSettings, UrlRule

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"


def _words(text: str, split: str = r"[\x20\x09-\x0D]+") -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{split}'), lambda x: x <> '')"


_TERMS = _words(_LOWER.format("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def line_dedup() -> str:
    return f"""with l as (select doc_id, unnest(x) as line, generate_subscripts(x, 1) as pos from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents)),
k as (select *, trim({_LOWER.format('line')}, {_BLANK}) as key from l),
o as (select key, min(doc_id) as owner from k where length(key) >= 10 group by key having count(distinct doc_id) > 1)
select doc_id, count(*) as n_lines, count(*) filter (where owner < doc_id) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where owner is null or owner >= doc_id), '')) as kept_sha256
from k left join o using (key) group by doc_id"""


def url_filter(rules: list[UrlRule], s: TreeSettings = TreeSettings()) -> str:
    parts = [(r, *r.prefix.partition("/")[::2]) for r in sorted(rules, key=lambda r: (-len(r.prefix), r.prefix))]
    when = " ".join(f"when (host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '/{path}') then '{r.verdict} {r.prefix}'" for r, host, path in parts)
    node = "host, template"
    return f"""with recursive p0 as (select page_id, coalesce(case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end, '') as rest from pages),
p1 as (select *, regexp_extract(rest, '^[^/?#]*') as raw from p0),
p2 as (select page_id, {_LOWER.format('raw')} as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from p1),
p3 as (select *, case {when} end as fit, string_split(regexp_replace(regexp_replace(path, '^/', ''), '[0-9]+', '#', 'g'), '/') as segs from p2),
rows as (select *, split_part(fit, ' ', 1) as label, split_part(fit, ' ', 2) as rule from p3),
shapes as (select host, segs, count(*) as pages, count(label) as labels, count(*) filter (where label = 'block') as blocks from rows group by host, segs),
tree as (
  select 0 as level, false as over, host, segs, pages, labels, blocks, '' as template from shapes
  union all
  (with o as (select * from tree where not over),
  c as (select level, host, segs, pages, labels, blocks, template, count(*) over (partition by {node}) = 1 or len(segs) <= level as done from o),
  f as (select level, host, segs, pages, labels, blocks, case when len(segs) > level then template || '/' || array_to_string(segs[level + 1:], '/') else template end as template from c where done),
  g as (select *, segs[level + 1] as part from c where not done),
  k0 as (select {node}, part, sum(pages) as pages, sum(labels) as labels, sum(blocks) as blocks from g group by {node}, part),
  k as (select *, count(*) over (partition by {node}) >= {s.wildcard} and sum(pages) over (partition by {node}) <= {s.rare} * count(*) over (partition by {node}) as variable from k0),
  d0 as (select *, blocks / labels as rate from k where not variable and labels >= {s.least}),
  d1 as (select *, lag(labels) over w as l0, lag(blocks) over w as b0 from d0 window w as (partition by {node} order by rate, part)),
  d2 as (select *, (blocks + b0) / (labels + l0) as p from d1),
  d3 as (select *, case when rate - b0 / l0 <= {s.z} * sqrt(p * (1 - p) * (1 / labels + 1 / l0)) then 0 else 1 end as breaks from d2),
  d4 as (select *, sum(breaks) over (partition by {node} order by rate, part) as branch from d3),
  m as (select {node}, part, case when count(*) over b > 1 then '~' || min(part) over b end as branch from d4 window b as (partition by {node}, branch)),
  s as (select k.host, k.template, k.part, case when variable then '*' else coalesce(branch, k.part) end as step from k left join m on k.host = m.host and k.template = m.template and k.part = m.part)
  select level, true, host, segs, pages, labels, blocks, template from f
  union all
  select level + 1, false, g.host, segs, pages, labels, blocks, g.template || '/' || step from g join s on g.host = s.host and g.template = s.template and g.part = s.part)),
t as (select * from tree where over),
prior as (select coalesce(sum(blocks) / nullif(sum(labels), 0), 0) as prior from t),
anywhere as (select template, (sum(blocks) + {s.weight} * any_value(prior)) / (sum(labels) + {s.weight}) as common from t, prior group by template),
hosts as (select host, sum(labels) as host_labels from t group by host),
sums as (select host, template, sum(labels) as evidence, sum(blocks) as blocks from t group by host, template),
own as (select host, template, evidence, (blocks + {s.weight} * case when contains(template, '/~') or host_labels = 0 then prior else common end) / (evidence + {s.weight}) as purity
  from sums join anywhere using (template) join hosts using (host), prior)
select page_id, r.host, path, rule, coalesce(label, case when evidence > 0 and purity >= {s.block_from} then 'block' else 'allow' end) as verdict, t.template, round(purity, 6) as purity
from rows r join t on r.host = t.host and r.segs = t.segs join own o on o.host = t.host and o.template = t.template"""


def ngram_join() -> str:
    w = _words(_LOWER.format("text"))
    return f"""with recursive d as (select doc_id, {w} as w from documents),
g as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] end) as s from d),
n as (select d.doc_id, count(s) as n from d left join g using (doc_id) group by d.doc_id),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as o from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (select a, b from both_ join n x on a = x.doc_id join n y on b = y.doc_id where 100 * o >= 75 * (x.n + y.n - o)),
edge as (select a, b from link union all select b, a from link),
reach as (select doc_id as a, doc_id as b from d union select r.a, e.b from reach r join edge e on r.b = e.a)
select n.doc_id, n.n as n_shingles, min(b) as component_id from n join reach on n.doc_id = reach.a group by n.doc_id, n.n"""


def decontamination(slop: int = SLOP) -> str:
    return f"""with i as (select cast(item_id as varchar) as item, {_TERMS} as w from benchmark),
bw as (select distinct item, w[s:s + least(13, len(w)) - 1] as terms from (select item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as s from i where len(w) > 0)),
m as (select distinct len(terms) as m from bw),
d as (select doc_id, {_TERMS} as w from documents),
dw as (select doc_id, s, m, w[s:s + m - 1] as terms from (select doc_id, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) as s from d, m)),
h as (select doc_id, s, m, item from dw join bw using (terms)),
p as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(s, s + m)) as pos from h) group by doc_id),
t as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by doc_id),
x as (select doc_id, unnest(w) as term, generate_subscripts(w, 1) as pos from d),
f as (select term, count(*) as df from x group by term),
bt as (select terms, unnest(terms) as term, generate_subscripts(terms, 1) as off from (select distinct terms from bw)),
br as (select bt.*, row_number() over (partition by terms order by df, term, off) as r from bt join f using (term) qualify count(*) over (partition by terms) = len(terms)),
ab as (select terms, min(term) filter (where r = 1) as ta, min(off) filter (where r = 1) as oa, min(term) filter (where r = least(2, len(terms))) as tb, min(off) filter (where r = least(2, len(terms))) as ob from br group by terms),
nw as (select distinct terms, xa.doc_id from ab join x xa on xa.term = ta join x xb on xb.term = tb and xb.doc_id = xa.doc_id and abs((xa.pos - oa) - (xb.pos - ob)) <= {slop}),
n as (select doc_id, count(distinct item) as n_near_items from nw join bw using (terms) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated, coalesce(n_near_items, 0) as n_near_items from d left join p using (doc_id) left join t using (doc_id) left join n using (doc_id)"""


def license_scan(templates: dict[str, list[str]] = TEMPLATES, threshold: int = THRESHOLD) -> str:
    quoted = lambda t: t.replace("'", "''")
    values = ", ".join(f"('{k}', {i}, '{quoted(t)}')" for k, v in templates.items() for i, t in enumerate(v))
    words = lambda c: _words(f"lower({c})", r"[^\p{L}\p{N}]+")
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""with t as (select license, variant, unnest({grams}) as g from (select license, variant, {words('t')} as w from (values {values}) v(license, variant, t)) where len(w) >= 2),
tn as (select license, variant, count(*) as m from t group by all),
u as (select doc_id, unnest(list_distinct(list_append(string_split(lower(text), chr(10)), lower(text)))) as passage from documents where text is not null),
b as (select doc_id, passage, unnest({grams}) as g from (select doc_id, passage, {words('passage')} as w from u) where len(w) >= 2),
bn as (select doc_id, passage, count(*) as n from b group by all),
h as (select doc_id, passage, license, variant, count(*) as o from b join t using (g) group by all),
j as (select doc_id, passage, license, 2 * o / (n + m) as dice from h join bn using (doc_id, passage) join tn using (license, variant) where 200 * o >= {threshold} * (n + m)),
best as (select doc_id, passage, license, dice from (select *, row_number() over (partition by doc_id, passage order by dice desc, license) as r from j) where r = 1),
f as (select doc_id, string_agg(distinct license, ',' order by license) as licenses, first(license order by dice desc, license) as best_license, max(dice) as best_dice, count(*) as n_passages from best group by doc_id)
select doc_id, coalesce(licenses, '') as licenses, best_license, round(coalesce(best_dice, 0), 6) as best_dice, coalesce(n_passages, 0) as n_passages from documents left join f using (doc_id)"""


def substring_dedup() -> str:
    return f"""with d as (select doc_id, {_words('text')} as w from documents),
x as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) as i from d)),
o as (select s, min(doc_id) as owner from x group by s),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as pos from x join o using (s) where owner < doc_id),
e as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from d),
k as (select doc_id, string_agg(word, ' ' order by pos) as kept from e anti join gone using (doc_id, pos) group by doc_id),
n as (select doc_id, count(*) as n from gone group by doc_id)
select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id) left join n using (doc_id)"""


def quality_rules(rules: tuple[Rule, ...] = RULES) -> str:
    def broken(r: Rule) -> str:
        sides = [f"100 * {r.count} < {r.per} * {r.low}" if r.low is not None else "", f"100 * {r.count} > {r.per} * {r.high}" if r.high is not None else ""]
        return f"(({' or '.join(x for x in sides if x)}) and n_words >= {r.min_words} and 100 * n_latin >= {r.min_latin} * word_chars)"

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""with d as (select doc_id, coalesce(text, '') as t, {_words('text')} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from documents),
x as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) as i from d)),
r as (select doc_id, count(distinct pos) as n from (select doc_id, unnest(range(i, i + 5)) as pos from (select *, count(*) over (partition by doc_id, s) as c from x) where c > 1) group by doc_id),
s as (select d.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, len(l) as n_lines,
  length(regexp_replace(t, '[^A-Za-z]', '', 'g')) as n_latin, length(regexp_replace(t, '[^!]', '', 'g')) as n_exclaims, len(list_filter(w, lambda x: length(x) > 1 and regexp_matches(x, '\\p{{Lu}}') and not regexp_matches(x, '\\p{{Ll}}'))) as n_upper_words, len(list_filter(w, lambda x: lower(x) in ({stop}))) as n_stop_words,
  len(list_filter(l, lambda x: ends_with(x, '...') or ends_with(x, '…'))) as n_ellipsis_lines, len(list_filter(l, lambda x: starts_with(x, '- ') or starts_with(x, '* ') or starts_with(x, '•'))) as n_bullet_lines from d left join r using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or {' or '.join(broken(r) for r in rules)}) as kept from b"""


def warc() -> str:
    return """with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
g as (select payload_digest, payload_bytes, max(page_id) as target from p where payload_bytes >= 1000 group by all having count(*) > 1)
select page_id, payload_bytes, payload_digest, case when target is null or target = page_id then 'response' else 'revisit' end as record_type, case when target <> page_id then target end as refers_to
from p left join g using (payload_digest, payload_bytes)"""
