"""SQL equivalents of the queries whose results SQL can express on whole tables."""

from __future__ import annotations

from tidewatch.llm import decontaminate, joins, minhash, quality, ranking

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANK = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _benchmark() -> str:
    w = decontaminate.WINDOW
    return f"""with d as (select row_number() over () as row_id, doc_id, {_ALNUM.format(_LOWER)} as words from documents),
 b as (select cast(item_id as varchar) as item, {_ALNUM.format(_LOWER)} as words from benchmark),
 phrases as (select distinct item, words[i:i + {w - 1}] as phrase
  from (select item, words, unnest(range(1, greatest(len(words) - {w - 1}, 1) + 1)) as i from b where len(words) > 0)),
 sizes as (select distinct len(phrase) as size from phrases),
 places as (select row_id, words, size, unnest(range(1, len(words) - size + 2)) as i from d cross join sizes where len(words) >= size),
 hits as (select row_id, i, size, item from places join phrases on words[i:i + size - 1] = phrase),
 covered as (select row_id, count(distinct j) as n from (select row_id, unnest(range(i, i + size)) as j from hits) group by row_id),
 found as (select row_id, count(*) as n, string_agg(item, ',' order by item) as items
  from (select distinct row_id, item from hits) group by row_id)
 select doc_id, cast(len(words) as bigint) as n_words, coalesce(covered.n, 0) as n_hit, coalesce(found.n, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(covered.n, 0) > 0 as contaminated
 from d left join covered using (row_id) left join found using (row_id)"""


def _similar(k: int, percent: int) -> str:
    """doc_id, n_shingles and component_id of every document."""
    return f"""with recursive d as (select doc_id, {_BLANK.format(_LOWER)} as words from documents),
 s as (select distinct doc_id, array_to_string(words[i:i + {k - 1}], ' ') as shingle
  from (select doc_id, words, unnest(range(1, greatest(len(words) - {k - 1}, 1) + 1)) as i from d where len(words) > 0)),
 n as (select doc_id, count(*) as n from s group by doc_id),
 common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (shingle) where a.doc_id < b.doc_id group by 1, 2),
 links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {percent} * (x.n + y.n - c)),
 edges as (select a, b from links union all select b, a from links),
 reach as (select doc_id, doc_id as other from n union select r.doc_id, e.b from reach r join edges e on e.a = r.other),
 lowest as (select doc_id, min(other) as component_id from reach group by doc_id)
 select doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, doc_id) as component_id
 from d left join n using (doc_id) left join lowest using (doc_id)"""


def _near_copies() -> str:
    found = _similar(minhash.SHINGLE, minhash.PERCENT)
    return f"select *, doc_id = component_id as kept from ({found})"


def _ranked() -> str:
    length, gain = ranking.LENGTH_PERCENT, ranking.GAIN
    return f"""with d as (select row_number() over () as row_id, doc_id, {_ALNUM.format(_LOWER)} as terms from documents),
 b as (select row_number() over () as item, item_id, {_ALNUM.format(_LOWER)} as terms from benchmark),
 n as (select row_id, doc_id, len(terms) as n from d where len(terms) > 0),
 c as (select count(*) as docs, cast(sum(n) as bigint) as total from n),
 q as (select distinct item, item_id, unnest(terms) as term from b),
 p as (select row_id, term, count(*) as tf from (select row_id, unnest(terms) as term from d)
  where term in (select term from q) group by row_id, term),
 w as (select term, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1))) as bigint) as w from p cross join c group by term, docs),
 s as (select item, item_id, row_id, doc_id,
   cast(sum(w * (({gain} * tf) // (1000 * tf + 20 * ({100 - length} + ({length} * n * docs) // total)))) as bigint) as score
  from q join p using (term) join w using (term) join n using (row_id) cross join c group by item, item_id, row_id, doc_id),
 r as (select *, cast(row_number() over (partition by item order by score desc, doc_id nulls last) as integer) as rank from s where score > 0)
 select item_id, rank, doc_id, score from r where rank <= {ranking.TOP}"""


def _trie() -> str:
    bit = "list_reduce([{}, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    letters = "list_transform(range(1, len(cast(conv_id as varchar)) + 1), lambda i: cast(ascii(cast(conv_id as varchar)[i]) as bigint))"
    crc = f"xor(list_reduce(list_concat([4294967295], {letters}), lambda a, b: {bit.format('xor(a, b)')}), 4294967295)"
    return f"""with o as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null),
 c as (select conv_id, conv_id - conv_id % 5 as base, count(*) as size, {crc} % 9 as h from o group by conv_id),
 k as (select c.conv_id, c.base, c.h, least(c.h, coalesce(b.size, 0)) as taken from c left join c b on b.conv_id = c.base),
 r as (select k.conv_id, o.pos, role, text from k join o on o.conv_id = k.base and o.pos <= k.h
  union all select k.conv_id, o.pos - h + taken, role, text from k join o on o.conv_id = k.conv_id and o.pos > h),
 s as (select k.conv_id, coalesce(list(struct_pack(role := role, text := text) order by pos) filter (where pos is not null), []) as turns
  from k left join r using (conv_id) group by k.conv_id),
 m as (select conv_id, turns, unnest(range(0, len(turns) + 1)) as depth from s),
 n as (select turns[1:depth] as key, depth, min(conv_id) as conv_id, count(*) as n_convs, bool_and(len(turns) = depth) as leaf,
  string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where len(turns) = depth) as ends from m group by 1, 2),
 v as (select *, case when depth = 0 then 0 else (n_convs - 1) * strlen(key[depth].text) end as saved from n),
 t as (select key[1:lev] as key, lev as depth, sum(cast(leaf as bigint)) as n_leaves, sum(saved) as saved_tokens, count(*) filter (where depth = lev + 1) as n_children
  from (select *, unnest(range(0, depth + 1)) as lev from v) group by 1, 2)
 select v.conv_id, v.depth, p.conv_id as parent_conv_id, v.n_convs, t.n_children, cast(t.n_leaves as bigint) as n_leaves,
  cast(t.saved_tokens as bigint) as saved_tokens, sha256(coalesce(v.ends, '')) as ends_sha256
  from v join t on t.depth = v.depth and t.key = v.key left join n p on p.depth = v.depth - 1 and p.key = v.key[1:v.depth - 1]"""


def _host_rules() -> str:
    w = quality.WINDOW
    return f"""with d as (select row_number() over () as row_id, doc_id, coalesce(source, '') as host, coalesce(text, '') as text,
  {_BLANK.format("coalesce(text, '')")} as words, string_split(coalesce(text, ''), chr(10)) as lines from documents),
 p as (select row_id, i, words[i:i + {w - 1}] as win from (select row_id, words, unnest(range(1, len(words) - {w - 2})) as i
  from d where len(words) >= {w})),
 again as (select row_id, i from (select row_id, i, count(*) over (partition by row_id, win) as c from p) where c > 1),
 hit as (select row_id, count(distinct j) as n from (select row_id, unnest(range(i, i + {w})) as j from again) group by row_id),
 m as (select row_id, doc_id, host, cast(len(words) as bigint) as n_words, cast(len(array_to_string(words, '')) as bigint) as word_chars,
  cast(len(regexp_extract_all(text, '[{quality.SYMBOLS}]')) as bigint) as n_symbols,
  list_filter(lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as own, coalesce(hit.n, 0) as n_repeat_words
  from d left join hit using (row_id)),
 r as (select *, cast(len(own) as bigint) as n_lines, cast(len(own) - len(list_distinct(own)) as bigint) as n_dup_lines,
  n_words < {quality.LEAST_WORDS} as few, 100 * n_repeat_words > {quality.REPEATED_PERCENT} * n_words as much from m),
 f as (select *, few or much as base_failed, cast(few as int) + cast(much as int) + cast(4 * n_symbols > n_words as int)
  + cast(2 * n_dup_lines > n_lines as int) + cast(word_chars > 15 * n_words or word_chars < 2 * n_words as int) as failed from r),
 hosts as (select host, count(*) as n, count(*) filter (where failed > 0) as k from f group by host),
 t as (select sum(k)::double as k, sum(n)::double as n, var_pop(k::double / n) as v, avg(1.0::double / n) as s from hosts),
 e as (select least(greatest(k / n, 0.001), 0.999) as mean, v, s from t),
 g as (select mean, greatest(v - mean * (1 - mean) * s, mean * (1 - mean) / 1000) as spread from e),
 q as (select mean, least(greatest(mean * (1 - mean) / spread - 1, 1.0), 1000.0) as total from g),
 rates as (select host, mean, (k + mean * total) / (n + total) as rate from hosts cross join q)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or failed >= 2 or (failed >= 1 and rate > 1.5 * mean) or rate > 0.6) as kept,
  round(rate, 9) as host_rate from f join rates using (host)"""


def oracle() -> dict[str, str]:
    sql = {
        "op5_host_rules": _host_rules(),
        "op6_fm_index": _benchmark(),
        "op7_minhash": _near_copies(),
        "op11_forward_trie": _trie(),
        "op12_mask_ranking": _ranked(),
        "op13_group_join": _similar(joins.SHINGLE, joins.PERCENT),
    }
    return {name: " ".join(text.split("\n")) for name, text in sql.items()}
