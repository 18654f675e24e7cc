"""DuckDB SQL for the queries that SQL can express."""

# Words are runs of letters and digits; anchors, windows and similarities follow ``decontaminate``.
LEAKS = r"""
with docs as (
  select distinct doc_id, list_filter(
    regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w
  from documents),
items as (
  select distinct item_id, w, len(w) as size, least(len(w), 5) as length from (
    select item_id, list_filter(
      regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w
    from benchmark) where len(w) > 0),
counted as (
  select *, size - length + 1 as n,
    least(size - length + 1, cast(floor((size - length + 1) * (0.2 / 1.8) + 1e-9) as int) + 1) as many
  from items),
anchors as (
  select distinct length, size, k * n // many as at_item,
    array_to_string(w[k * n // many + 1 : k * n // many + length], ' ') as shingle
  from (select *, unnest(range(0, many)) as k from counted)),
places as (
  select doc_id, w, length, unnest(range(0, len(w) - length + 1)) as at_doc
  from docs, (select distinct length from items) where len(w) >= length),
windows as (
  select distinct doc_id, start, size, array_to_string(w[start + 1 : start + size], ' ') as text, length
  from (
    select doc_id, w, size, length, greatest(0, least(at_doc - at_item, len(w) - size)) as start
    from (select *, array_to_string(w[at_doc + 1 : at_doc + length], ' ') as shingle from places)
    join anchors using (length, shingle))),
own as (
  select text, size, length, shingle, count(*) as n from (
    select text, size, length, unnest(list_transform(range(0, len(w) - least(length, len(w)) + 1),
      lambda k: array_to_string(w[k + 1 : k + least(length, len(w))], ' '))) as shingle
    from (select distinct text, size, length, string_split(text, ' ') as w from windows))
  group by all),
theirs as (
  select item_id, w, size, length, shingle, count(*) as n from (
    select item_id, w, size, length, unnest(list_transform(range(0, size - length + 1),
      lambda k: array_to_string(w[k + 1 : k + length], ' '))) as shingle from items)
  group by all),
shared as (
  select text, size, item_id, w, sum(least(own.n, theirs.n)) as common
  from own join theirs using (size, length, shingle) group by all),
alike as (
  select text, size, item_id, max(common / (a.n + b.n - common)) as similarity
  from shared
  join (select text, size, sum(n) as n from own group by all) a using (text, size)
  join (select item_id, w, sum(n) as n from theirs group by all) b using (item_id, w)
  group by all having max(common / (a.n + b.n - common)) >= 0.8)
select doc_id, item_id, cast(arg_min(start, (-similarity, start)) as int) as start_word,
  cast(max(similarity) as double) as similarity
from windows join alike using (text, size) group by doc_id, item_id
"""

WARC = """
select page_id, payload_bytes, payload_digest,
  case when again then 'revisit' else 'response' end as record_type,
  case when again then first_id end as refers_to
from (
  select *, payload_bytes >= 100 and page_id > first_id as again from (
    select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest,
      min(page_id) over (partition by coalesce(html, '')) as first_id
    from pages))
"""



def _tree_levels(levels: int) -> str:
    """The template after each level: wild children are those like their node, and small ones of many with few labels."""
    out = ""
    for k in range(1, levels + 1):
        pooled = "(ag / greatest(al, 1))"
        out += f"""
child{k} as (
  select host, template, segments[{k}] as segment, sum(n) as n, sum(labelled) as l, sum(good) as g
  from tree{k - 1} where len(segments) >= {k} group by all),
key{k} as (
  select host, template, segment,
    case when (b > 16 and n * 16 < an and l < 8) or abs(g - l * {pooled}) <= 2.0 * sqrt(l * {pooled} * (1 - {pooled})) + 1e-9
      then '*' else segment end as key
  from child{k} join (
    select host, template, count(*) as b, sum(n) as an, sum(l) as al, sum(g) as ag from child{k} group by all)
  using (host, template)),
tree{k} as (
  select t.host, t.shape, t.segments, t.n, t.labelled, t.good,
    case when key is null then t.template else t.template || '/' || key end as template
  from tree{k - 1} t left join key{k} k
    on k.host = t.host and k.template = t.template and k.segment = t.segments[{k}]),"""
    return out


def _urls() -> str:
    """Rules as cases, longest first; the tree of ``url_templates`` with its eight levels."""
    fits = "host = '{0}' or host like '%.{0}'"
    rules = [("example.com/de/", "block"), ("example.net/en/", "allow"), ("org/fr/", "allow"), ("net/", "block")]
    cases = [
        f"when ({fits.format(rule.partition('/')[0])}) and starts_with(path, '/{rule.partition('/')[2]}') then '{rule}'"
        for rule, _ in rules
    ]
    verdicts = " ".join(f"when '{rule}' then '{verdict}'" for rule, verdict in rules)
    split = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"
    parts = f"""translate(regexp_extract(coalesce(url, ''), {split}, 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(coalesce(url, ''), {split}, 2) as path"""
    return f"""
with numbered as (
  select url, try_cast(regexp_extract(url, '/([0-9]{{1,18}})(?:[./?#]|$)', 1) as bigint) as doc_id from pages),
urls as (
  select url, cast(null as boolean) as good from pages
  union all select url, quality = 1 and toxic = 0 from numbered join labels using (doc_id)
    where (quality = 1 and toxic = 0) is not null),
shaped as (
  select host, path, good, regexp_replace(
    regexp_replace(regexp_replace(path, '[0-9]+', '*', 'g'), '/+', '/', 'g'), '(.)/$', '\\1') as shape
  from (select good, {parts} from urls)),
counted as (
  select host, shape, count(*) as n, count(good) as labelled, coalesce(sum(good::int), 0) as good,
    list_filter(string_split(shape, '/'), lambda x: x <> '') as s
  from shaped group by host, shape),
tree0 as (
  select host, shape, n, labelled, good, '' as template,
    case when len(s) <= 8 then s else list_concat(s[1:7], [array_to_string(s[8:], '/')]) end as segments
  from counted),{_tree_levels(8)}
pooled as (
  select host, template, sum(good) as good, sum(labelled) as labelled from tree8 group by all),
prior as (
  select case when sum(labelled) > 0 then sum(good) / sum(labelled) else 1.0 end as share from tree8),
rejected as (
  select t.host, t.shape, t.template, (p.good + 8.0 * share) / (p.labelled + 8.0) as purity
  from tree8 t join pooled p using (host, template) cross join prior
  where (p.good + 8.0 * share) / (p.labelled + 8.0) < 0.5),
judged as (
  select page_id, host, path, case {" ".join(cases)} end as rule, regexp_replace(
    regexp_replace(regexp_replace(path, '[0-9]+', '*', 'g'), '/+', '/', 'g'), '(.)/$', '\\1') as shape
  from (select page_id, {parts} from pages))
select page_id, host, path, rule,
  coalesce(case rule {verdicts} end, case when purity is not null then 'block' else 'allow' end) as verdict,
  template as rejected_template, purity
from judged left join rejected using (host, shape)
"""


_TERMS = r"""regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

#: All documents scored for all items, term by term.
RANKED = f"""
with split as (
  select row_number() over () as k, doc_id, {_TERMS} as terms from documents),
docs as (select k, doc_id, terms, len(terms)::bigint as n from split where len(terms) > 0),
total as (select count(*)::bigint as docs, sum(n)::bigint as terms from docs),
lengths as (
  select k, doc_id, 25 + ((75 * n * total.docs) // total.terms) as m from docs, total),
held as (
  select k, term, count(*)::bigint as tf from (select k, unnest(terms) as term from docs) group by k, term),
weights as (
  select term, floor(1000 * ln((2 * total.docs + 2)::double / (2 * df + 1)::double))::bigint as w
  from (select term, count(*)::bigint as df from held group by term), total),
asked as (
  select j, item_id, term, count(*)::bigint as times
  from (select j, item_id, unnest(terms) as term
    from (select row_number() over () as j, item_id, {_TERMS} as terms from benchmark))
  group by j, item_id, term),
scored as (
  select j, item_id, k, doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from asked join weights using (term) join held using (term) join lengths using (k)
  group by j, item_id, k, doc_id)
select item_id, rank, doc_id, score
from (select item_id, doc_id, score,
    (row_number() over (partition by j order by score desc, doc_id nulls last))::int as rank
  from scored where score > 0)
where rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_benchmark_leaks": LEAKS,
        "op5_warc": WARC,
        "op6_url_templates": _urls(),
        "op12_ranked_search": RANKED,
    }
