"""The registered queries as plain SQL over the same tables."""

from __future__ import annotations

from tidewatch.schema import ATTACK_CATEGORIES, METHODS, SUSPICIOUS_PATTERNS, feature_names

_IP = "concat('10.0.', cast(user_id // 256 as varchar), '.', cast(user_id % 256 as varchar))"
LOGS = f"""logs as (
 select event_id as line_no, ts as ingest_ts, case
  when event_id % 100 = 13 then ''
  when event_id % 100 = 11 then concat('invalid log line ', cast(event_id as varchar))
  when event_id % 100 = 17 then concat({_IP}, ' WARN "PUT /job/', cast(event_id % 9 as varchar), ' HTTP/1.1" 503 upstream')
  else concat({_IP}, ' - - [', strftime(ts, '%d/%b/%Y:%H:%M:%S'),
   case when event_id % 40 = 9 then ' -0500' else ' +0000' end, '] "',
   case event_type when 'purchase' then 'POST' when 'error' then 'DELETE' when 'signup' then 'PUT' else 'GET' end,
   ' /', event_type, '/', cast(event_id % 37 as varchar),
   case when event_id % 50 = 0 then '/../../etc/passwd' when event_id % 50 = 21 then '?q=1+UNION+SELECT' else '' end,
   ' HTTP/1.1" ', case when event_type = 'error' then '500' when event_id % 11 = 0 then '404' else '200' end, ' ',
   case when event_id % 50 = 7 then '-' else cast(cast(floor(value * 100) as bigint) as varchar) end,
   case when event_id % 20 = 3 then '' else concat(' "-" "agent/', cast(user_id % 7 as varchar), '"') end)
 end as line from events)"""

_COMMON = r'^([\d.]+) - (\S+) \[([^\]]+)\] "(\S+) (\S+) (\S+)" (\d+) (\S+)'
_HEAD = _COMMON.replace("(", "(?:")  # DuckDB returns at most nine groups
_TAIL = r' "([^"]*)" "([^"]*)"'
_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

_KIND = {
    "auto": "case when blank then 'empty' when full_match then 'combined' when any_match then 'common' else 'simple' end",
    "apache_combined": "case when not blank and full_match then 'combined' else 'empty' end",
    "nginx": "case when not blank and full_match and regexp_full_match(regexp_extract(line, '{c}', 8), '\\d+') "
    "then 'combined' else 'empty' end".replace("{c}", _COMMON),
    "common": "case when not blank and any_match then 'common' else 'empty' end",
    "simple": "case when blank then 'empty' else 'simple' end",
}


def _times(text: str, source: str) -> str:
    """Adds clock and zone of a time text; the shapes are those the parser accepts."""
    access = r"^(\d{1,2}/[A-Za-z]{3}/\d{4}:\d{1,2}:\d{1,2}:\d{1,2})(\s+(Z|[+-]\d{2}:?[0-5]\d))?$"
    iso = r"^\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$"
    return f"""select *,
  case when regexp_matches({text}, '{access}')
    then try_strptime(regexp_extract({text}, '{access}', 1), '%d/%b/%Y:%H:%M:%S')
   when regexp_matches({text}, '{iso}') then try_strptime({text}, '%Y-%m-%d %H:%M:%S') end as clock,
  replace(regexp_extract({text}, '{access}', 3), ':', '') as zone_digits
  from {source}"""


_OFFSET = """case when zone_digits in ('', 'Z') then 0 else
 (case when zone_digits[1] = '-' then -1 else 1 end)
 * (cast(zone_digits[2:3] as bigint) * 3600 + cast(zone_digits[4:5] as bigint) * 60) end"""
_INSTANT = f"coalesce(epoch_us(clock) - 1000000 * ({_OFFSET}), epoch_us(ingest_ts))"
_ZONE = """case when clock is null or zone_digits = '' then '' when zone_digits in ('Z', '-0000') then '+00:00'
 else concat(zone_digits[1:3], ':', zone_digits[4:5]) end"""
_WALL = "coalesce(clock, ingest_ts)"
_WALL_TEXT = f"strftime({_WALL}, '%Y-%m-%d %H:%M:%S.%f')"

_OCTETS = "(regexp_full_match(word, '([+-]?\\d+\\.){3}[+-]?\\d+') and " + " and ".join(
    f"coalesce(try_cast(split_part(word, '.', {i}) as integer) between 0 and 255, false)" for i in range(1, 5)
) + ")"


def parsed(fmt: str = "auto") -> str:
    """CTEs up to ``p``: the parsed rows."""
    by = "parse_kind in ('combined', 'common')"
    methods = " ".join(f"when contains(line, '{m}') then '{m}'" for m in METHODS)

    def part(i: int, default: str, lenient: str | None = None) -> str:
        middle = f"when parse_kind = 'simple' then {lenient}" if lenient else ""
        return f"case when {by} then regexp_extract(line, '{_COMMON}', {i}) {middle} else '{default}' end"

    def tail(i: int) -> str:
        return f"case when parse_kind = 'combined' then regexp_extract(line, '{_HEAD}{_TAIL}', {i}) else '-' end"

    return f"""{LOGS},
 m as (select *, regexp_matches(line, '^\\s*$') as blank, regexp_matches(line, '{_COMMON}{_TAIL}') as full_match,
   regexp_matches(line, '{_COMMON}') as any_match, regexp_extract(line, '^\\s*(\\S+)', 1) as word from logs),
 k as (select *, {_KIND[fmt]} as parse_kind from m),
 t0 as (select *, case when {by} then regexp_extract(line, '{_COMMON}', 3) else '' end as time_text from k),
 t as ({_times('time_text', 't0')}),
 p as (select line_no, ingest_ts, line, parse_kind, {_INSTANT} as event_us, {_WALL} as wall_ts, {_ZONE} as zone,
  {part(1, 'unknown', f"(case when {_OCTETS} then word else 'unknown' end)")} as ip,
  {part(2, '-')} as "user",
  {part(4, 'GET', f"(case {methods} else 'GET' end)")} as method,
  {part(5, '/', f"coalesce(nullif(regexp_extract(line, '\"\\w+ (\\S+) ', 1), ''), '/')")} as path,
  {part(6, 'HTTP/1.1')} as protocol,
  cast(case when {by} then regexp_extract(line, '{_COMMON}', 7)
   when parse_kind = 'simple' then coalesce(nullif(regexp_extract(line, '" (\\d{{3}}) ', 1), ''), '200')
   else '0' end as bigint) as status,
  case when {by} and regexp_full_match(regexp_extract(line, '{_COMMON}', 8), '[+-]?\\d+')
   then cast(regexp_extract(line, '{_COMMON}', 8) as bigint) else 0 end as size,
  {tail(1)} as referrer, {tail(2)} as user_agent,
  case when parse_kind = 'empty' then '' else line end as raw from t)"""


_PARSED_OUT = f"""line_no, parse_kind, event_us, ip, "user", method, path, protocol, status, size, referrer, user_agent,
 raw, zone, strftime(wall_ts, '%Y-%m-%d %H:%M:%S.%f') as wall"""

DOC_LINES = f"""pieces as (select doc_id, unnest(parts) as raw_line, generate_subscripts(parts, 1) - 1 as place
  from (select doc_id, string_split_regex(text, '\\r\\n|\\r|\\n') as parts from documents)),
 lines as (select doc_id * 4294967296 + place as line_no, line from (
  select doc_id, place, regexp_replace(replace(raw_line, chr(65533), ''), '^{_SPACES}|{_SPACES}$', '', 'g') as line
  from pieces) where line <> '')"""

_SPLIT = """halves as (select line_no, line, case when
  row_number() over (order by md5(concat('42:', cast(line_no as varchar))), line_no)
   <= floor(count(*) over () * (1.0::double - 0.2::double)) then 'train' else 'validation' end as split from lines)"""

_MASKED = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(line,
  '\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}', '<ip>', 'g'), '\\[[^\\]]*\\]', '<ts>', 'g'),
  '0x[0-9A-Fa-f]+', '<hex>', 'g'), '\\d+', '<*>', 'g')"""

_SIGNATURES = f"""signed as (select line_no, ingest_ts, line, case when trim(line) <> '' then {_MASKED} end as signature from logs),
 dictionary as (select signature, count(*) as n, min(line_no) as first_line_no,
  row_number() over (order by min(line_no)) as template_id from signed where signature is not null group by signature)"""


def _stats(source: str) -> str:
    """CTE ``s``: per-address statistics of rows (line_no, ip, path, event_us)."""
    return f"""w as (select *,
   count(*) over (partition by ip order by event_us range between 3599999999 preceding and current row)
   - count(*) over (partition by ip, event_us order by line_no rows between 1 following and unbounded following) as in_window,
   greatest(min(event_us) over (partition by ip order by event_us range between 3599999999 preceding and current row),
    lag(event_us, 999) over (partition by ip order by event_us, line_no)) as start_us,
   row_number() over (partition by ip, path order by event_us, line_no) = 1 as is_first from {source}),
  s as (select *, least(in_window, 1000) as ip_frequency,
   cast(sum(cast(is_first as integer)) over (partition by ip order by event_us, line_no
    rows between unbounded preceding and current row) as bigint) as ip_path_diversity,
   case when in_window > 1 then least(in_window, 1000) / greatest((event_us - start_us) / 60000000.0::double, 1.0)
    else 0.0 end as ip_request_rate from w)"""


def _features(source: str, rate: str = "cast(ip_request_rate as float)") -> dict[str, str]:
    """Feature expressions over parsed rows joined to their statistics and dictionary."""
    tokens = " + ".join(
        f"cast(contains(lower(path), '{p}') or contains(lower(raw), '{p}') as integer)" for p in SUSPICIOUS_PATTERNS
    )
    out = {
        "template_id": "coalesce(template_id, -1)",
        "status_2xx": "cast(status between 200 and 299 as integer)",
        "status_4xx": "cast(status between 400 and 499 as integer)",
        "status_5xx": "cast(status between 500 and 599 as integer)",
        "path_length": "length(path)",
        "suspicious_score": tokens,
        "hour": "hour(wall_ts)",
        "weekday": "isodow(wall_ts) - 1",
        "ip_frequency": "ip_frequency",
        "ip_path_diversity": "ip_path_diversity",
        "ip_request_rate": rate,
        "user_agent_hash": "case when user_agent in ('-', '') then 0 else "
        "cast(concat('0x', substr(md5(user_agent), 1, 8)) as bigint) % 10000 end",
    }
    for m in METHODS:
        out[f"method_{m}"] = f"cast(upper(method) = '{m}' as integer)"
    return {c: f"cast({out[c]} as double)" for c in feature_names()}


_NUMERIC = feature_names()


def _numeric_features() -> str:
    cols = ", ".join(f"{x} as {c}" for c, x in _features("").items())
    return f"""{parsed()}, {_SIGNATURES}, pos as (select p.*, template_id from p join signed using (line_no)
  left join dictionary using (signature) where status > 0), {_stats('pos')},
 f as (select line_no, {cols} from s)"""


def _templates(source: str) -> str:
    """Mined templates of rows (line_no, line)."""
    return f"""{source}, marked as (select line_no, {_MASKED} as signature from rows_ where trim(line) <> ''),
 d as (select signature, count(*) as n, min(line_no) as first_line_no, string_split_regex(signature, '{_SPACES}') as toks
  from marked group by signature),
 t as (select *, len(toks) as size, case when regexp_matches(toks[1], '\\d') then '<*>' else toks[1] end as lead from d),
 wide as (select size, count(distinct lead) > 100 as open from t group by size),
 b as (select t.*, concat(cast(size as varchar), ' ', case when open then '<*>' else lead end) as bucket from t join wide using (size)),
 pos as (select bucket, signature, unnest(toks) as token, generate_subscripts(toks, 1) as place from b),
 kinds as (select bucket, place, count(distinct token) as k, min(token) as one from pos group by bucket, place),
 rules as (select bucket, count(*) filter (where k = 1 and one <> '<*>') >= 0.5 * count(*) as whole from kinds group by bucket),
 shaped as (select bucket, signature, string_agg(case when k > case when whole then 1 else 100 end then '<*>' else token end, ' ' order by place)
  as template from pos join kinds using (bucket, place) join rules using (bucket) group by bucket, signature),
 totals as (select template, cast(sum(n) as bigint) as n, min(first_line_no) as first_line_no from shaped join d using (signature) group by template)
 select row_number() over (order by first_line_no, template) as template_id, template, n, first_line_no from totals"""


_ROUNDS = 12  # rounds of cutting; each halves the places that a group still lacks


def _clusters(source: str) -> str:
    """CTEs up to ``clusters`` (template_id, template, n, first_line_no) and ``members`` of rows (line_no, line)."""
    rounds, done = "", []
    for i in range(_ROUNDS):
        rounds += f""",
 k{i} as materialized (select g, place, count(distinct token) as k, min(token) as one
  from (select g, unnest(toks) as token, generate_subscripts(toks, 1) as place from g{i}) group by g, place),
 s{i} as materialized (select g, cast(ceil(count(*) * 0.5) as bigint) - count(*) filter (where k = 1 and one <> '<*>') as missing,
  coalesce(list(place order by k, place) filter (where k > 1), []) as loose from k{i} group by g),
 g{i + 1} as materialized (select concat(g, ' ', array_to_string(list_transform(loose[1:(missing + 1) // 2],
   lambda x: concat(cast(x as varchar), ':', toks[x], chr(1))), '')) as g, bucket, signature, toks, n, first_line_no
  from g{i} join s{i} using (g) where missing > 0 and len(loose) > 0)"""
        done.append(f"select g{i}.* from g{i} join s{i} using (g) where missing <= 0 or len(loose) = 0")
    return f"""{source}, marked as (select line_no, {_MASKED} as signature from rows_ where trim(line) <> ''),
 d as (select signature, count(*) as n, min(line_no) as first_line_no, string_split_regex(signature, '{_SPACES}') as toks
  from marked group by signature),
 t as (select *, len(toks) as size, case when regexp_matches(toks[1], '\\d') then '<*>' else toks[1] end as lead from d),
 wide as (select size, count(distinct lead) > 100 as open from t group by size),
 g0 as materialized (select concat(cast(size as varchar), chr(1), case when open then '<*>' else lead end) as g, g as bucket,
  signature, toks, n, first_line_no from t join wide using (size)){rounds},
 groups as materialized ({" union all ".join(done)}),
 shared as (select g, string_agg(case when k = 1 then one else '<*>' end, ' ' order by place) as template from (
  select g, place, count(distinct token) as k, min(token) as one
  from (select g, unnest(toks) as token, generate_subscripts(toks, 1) as place from groups) group by g, place) group by g),
 totals as (select template, cast(sum(n) as bigint) as n, min(first_line_no) as first_line_no
  from groups join shared using (g) group by template),
 clusters as materialized (select row_number() over (order by first_line_no, template) as template_id, template, n, first_line_no from totals),
 members as (select distinct bucket, template_id, template, string_split(template, ' ') as held
  from groups join shared using (g) join clusters using (template))"""


def _matched(source: str) -> str:
    """The most similar cluster of rows (line_no, line) ``all_``, mined from ``rows_``."""
    return f"""with {_clusters(source)},
 signed as (select line_no, case when trim(line) <> '' then {_MASKED} end as signature from all_),
 own as (select distinct signature, string_split_regex(signature, '{_SPACES}') as toks from signed where signature is not null),
 own2 as (select *, case when regexp_matches(toks[1], '\\d') then '<*>' else toks[1] end as lead from own),
 near as (select signature, template_id, template,
   len(list_filter(list_zip(toks, held), lambda x: x[1] = x[2] and x[2] <> '<*>')) as agreeing,
   cast(ceil(len(toks) * 0.5) as bigint) as needed, array_to_string(toks, ' ') = template as same
  from own2 join members on bucket = concat(cast(len(toks) as varchar), chr(1), lead)
   or bucket = concat(cast(len(toks) as varchar), chr(1), '<*>')),
 best as (select signature, arg_min(template_id, (-agreeing, template_id)) as template_id from near where agreeing >= needed or same group by signature)
 select line_no, coalesce(template_id, -1) as template_id, coalesce(template, '') as template
  from signed left join best using (signature) left join clusters using (template_id)"""


def _many() -> str:
    from tidewatch.plans.queries import MANY_PATTERNS

    listed = ", ".join(f"({i}, '{p.lower()}')" for i, p in enumerate(MANY_PATTERNS))
    return f"""with {parsed()}, pats as (select * from (values {listed}) v(k, pat))
 select line_no, cast(count(k) as integer) as patterns from p left join pats on contains(lower(path), pat) or contains(lower(raw), pat)
 group by line_no"""


def _scaler(where: str = "") -> str:
    rows = " union all ".join(
        f"select {i} as idx, '{c}' as feature, avg({c}) as mean, "
        f"case when stddev_pop({c}) = 0 then 1.0 else stddev_pop({c}) end as scale, count(*) as n from f {where}"
        for i, c in enumerate(_NUMERIC)
    )
    return f"z as ({rows})"


def _scaled(where: str = "") -> str:
    fits = ", ".join(
        f"avg({c}) as m_{c}, case when stddev_pop({c}) = 0 then 1.0 else stddev_pop({c}) end as s_{c}" for c in _NUMERIC
    )
    cols = ", ".join(f"round(({c} - m_{c}) / s_{c}, 3) + 0.0 as {c}" for c in _NUMERIC)
    return f"with {_numeric_features()}, q as (select {fits} from f {where}) select line_no, {cols} from f cross join q"


def _feature_query(*names: str) -> str:
    cols = ", ".join(f"{x} as {c}" for c, x in _features("").items() if c in names)
    if "template_id" in names:
        return f"""with {parsed()}, {_SIGNATURES}
 select p.line_no, {cols} from p join signed using (line_no) left join dictionary using (signature)"""
    return f"with {parsed()} select line_no, {cols} from p"


def _dense() -> str:
    return """dense as (select event_id as line_no, concat('10.9.9.', cast(user_id % 3 as varchar)) as ip,
  1704067200000000 + cast(floor(event_id * 0.6) as bigint) * 1000000 as event_us,
  concat('/', event_type, '/', cast(event_id % 37 as varchar)) as path from events)"""


def _explain() -> str:
    first = " ".join(f"when contains(lower(path), '{p}') then '{p}'" for p in SUSPICIOUS_PATTERNS)
    return f"""with {parsed()}, {_SIGNATURES},
 r as (select line_no, line_no % 3 <> 0 as anomaly, (line_no % 4000) * 0.75::double + 0.001::double as score,
  concat_ws(' + ',
   case when coalesce(template_id, -1) = -1 or template_id > 12 then 'rare log template' end,
   case when status >= 500 then 'server error (5xx)' when status >= 400 then 'client error (4xx)' end,
   'suspicious pattern: ' || (case {first} end),
   case when length(path) > 200 then 'unusually long path' end,
   case when method in ('DELETE', 'PUT', 'PATCH') then 'uncommon method: ' || method end) as reasons
  from p join signed using (line_no) left join dictionary using (signature))
 select line_no, case when not anomaly then 'Normal behavior detected' when reasons <> '' then reasons
  else concat('high anomaly score (', format('{{:.2f}}', score), ')') end as reason from r"""


def _attacks() -> str:
    parts = []
    for name, tokens in ATTACK_CATEGORIES.items():
        hit = " or ".join(f"contains(lower(path), '{t}') or contains(lower(raw), '{t}')" for t in tokens)
        parts.append(f"select '{name}' as category, count(*) filter (where {hit}) as requests from p")
    return f"with {parsed()} " + " union all ".join(parts)


def _custom() -> str:
    pattern = r'^([\d.]+) .* "(\S+) (\S+).*" (\d+)'
    hit = f"regexp_matches(line, '{pattern}')"
    return f"""with {LOGS} select line_no, case when {hit} then 'custom' else 'empty' end as parse_kind,
 case when {hit} then regexp_extract(line, '{pattern}', 1) else 'unknown' end as ip,
 case when {hit} then regexp_extract(line, '{pattern}', 2) else 'GET' end as method,
 case when {hit} then regexp_extract(line, '{pattern}', 3) else '/' end as path,
 case when {hit} then cast(regexp_extract(line, '{pattern}', 4) as bigint) else 0 end as status from logs"""


def _time_texts() -> str:
    clock = "strftime(ts, '%d/%b/%Y:%H:%M:%S')"
    return f"""texts as (select event_id as line_no, ts as ingest_ts, case event_id % 8
   when 0 then {clock} || ' +0000' when 1 then strftime(ts, '%-d/%b/%Y:%-H:%-M:%-S') || ' -0530'
   when 2 then strftime(ts, '%Y-%m-%d %H:%M:%S') when 3 then {clock} when 4 then {clock} || ' +02:00'
   when 5 then {clock} || ' Z' when 6 then strftime(ts, '%Y/%m/%d %H:%M') else '' end as "timestamp" from events)"""


def oracle() -> dict[str, str]:
    fits_text = "concat_ws('.', cast(user_id as varchar), cast(event_id % 300 as varchar), '+1', '007')"
    scaler = f"""with {_numeric_features()}, {_scaler()}
 select idx, feature, round(mean, 5) + 0.0 as mean, round(scale, 5) + 0.0 as scale, n from z"""
    mad = """with c as (select median(value) as m from events)
 select round(m + 3.5 * median(abs(value - m)), 6) + 0.0 as threshold from events cross join c group by m"""
    rate = "coalesce(count(*) filter (where status >= 500) / nullif(count(*), 0)::double, 0.0)"
    counters = f"""with {parsed()} select count(*) as total, count(*) filter (where status >= 500) as anomalies,
 round({rate}, 6) + 0.0 as anomaly_rate from p"""
    sql = {
        "scan_lines": f"with {DOC_LINES} select line, count(*) as copies, cast(0 as bigint) as gaps from lines group by line",
        "write_read_roundtrip": f"with {DOC_LINES}, {_SPLIT} select split, line, count(*) as copies from halves group by split, line",
        "parse_auto": f"with {parsed()} select {_PARSED_OUT} from p",
        "parse_combined": f"with {parsed('apache_combined')} select {_PARSED_OUT} from p where parse_kind = 'combined'",
        "parse_nginx": f"with {parsed('nginx')} select {_PARSED_OUT} from p where parse_kind = 'combined'",
        "parse_common": f"with {parsed('common')} select {_PARSED_OUT} from p where parse_kind = 'common'",
        "parse_simple": f"with {parsed('simple')} select {_PARSED_OUT} from p",
        "parse_blank": f"with {parsed()} select {_PARSED_OUT} from p where parse_kind = 'empty'",
        "parse_format_strict": f"with {parsed('apache_combined')} select {_PARSED_OUT} from p",
        "parse_custom": _custom(),
        "parse_timestamp": f"""with {_time_texts()}, t as ({_times('"timestamp"', 'texts')})
 select line_no, "timestamp", {_INSTANT} as event_us, {_ZONE} as zone, {_WALL_TEXT} as wall from t""",
        "is_ipv4": f"""with c as (select event_id, case when event_id % 5 = 0 then concat({fits_text}, '.1')
  when event_id % 5 = 1 then concat({fits_text}, 'x') else {fits_text} end as word from events)
 select event_id, word as text, {_OCTETS} as valid from c""",
        "filter_min_length": f"with {DOC_LINES} select line_no, line from lines where length(line) >= 20",
        "dedup_lines": f"with {DOC_LINES} select line, min(line_no) as line_no from lines group by line",
        "split_train_val": f"with {DOC_LINES}, {_SPLIT} select line_no, split from halves",
        "sample_exact": f"""with {DOC_LINES} select line_no, line from lines
 qualify row_number() over (order by md5(concat('42:', cast(line_no as varchar))), line_no) <= 1000""",
        "prepare_training_data": f"""with {DOC_LINES}, {_SPLIT}, d as (select split, min(line_no) as line_no, line from halves
  where length(line) >= 20 group by split, line)
 select split, line_no, line from d qualify split = 'validation' or
  row_number() over (partition by split order by md5(concat('42:', cast(line_no as varchar))), line_no) <= 2000""",
        "min_sample_guard": f"with {DOC_LINES} select count(*) as total, count(*) >= 1000 as enough from lines",
        "require_samples": f"with {DOC_LINES} select line_no, line from lines",
        "require_samples_raises": f"""with {DOC_LINES} select count(*) as total, true as raised,
 concat('need at least ', cast(count(*) + 1 as varchar), ' lines, got ', cast(count(*) as varchar)) as message from lines""",
        "mine_templates": "with " + _templates(f"{LOGS}, rows_ as (select line_no, line from logs)"),
        "mine_templates_documents": "with " + _templates(f"{DOC_LINES}, rows_ as (select line_no, line from lines)"),
        "filter_parsed": f"with {parsed()} select line_no, status, path from p where status > 0",
        "assign_batches": f"""with {DOC_LINES} select line_no,
 cast((row_number() over (order by line_no) - 1) // 100 as bigint) as batch_id from lines""",
        "mine_clusters": "with " + _clusters(f"{LOGS}, rows_ as (select line_no, line from logs)") + " select * from clusters",
        "mine_clusters_documents": "with " + _clusters(f"{DOC_LINES}, rows_ as (select line_no, line from lines)") + " select * from clusters",
        "stream_clusters": "with " + _clusters(f"{LOGS}, rows_ as (select line_no, line from logs)") + " select * from clusters",
        "stream_detect_learning": "select line_no, template_id from ("
        + _matched(f"{LOGS}, all_ as (select line_no, line from logs), rows_ as (select line_no, line from logs where ingest_ts < '2024-01-02')")
        + ")",
        "match_clusters": _matched(
            f"{LOGS}, all_ as (select line_no, line from logs), rows_ as (select line_no, line from logs where ingest_ts < '2024-01-02')"
        ),
        "match_clusters_documents": _matched(
            f"{DOC_LINES}, all_ as (select line_no, line from lines), rows_ as (select line_no, line from lines where line_no // 4294967296 % 2 = 0)"
        ),
        "feat_template": _feature_query("template_id"),
        "feat_status": _feature_query("status_2xx", "status_4xx", "status_5xx"),
        "feat_path_length": _feature_query("path_length"),
        "feat_suspicious": _feature_query("suspicious_score"),
        "feat_method": _feature_query(*[f"method_{m}" for m in METHODS]),
        "feat_time": _feature_query("hour", "weekday"),
        "feat_ua_hash": _feature_query("user_agent_hash"),
        "features_all": f"""with {parsed()}, {_stats('p')}, {_SIGNATURES} select s.line_no, """
        + ", ".join(f"round({x}, 3) + 0.0 as {c}" for c, x in _features("").items())
        + " from s join signed using (line_no) left join dictionary using (signature)",
        "feature_names": f"with {_numeric_features()}, {_scaler()} select idx, feature, n as rows from z",
        "format_timestamp": "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as text from events",
        "safe_divide": """select l_orderkey, l_linenumber,
 round(case when l_discount = 0 then -1.0 else l_extendedprice / l_discount end, 4) + 0.0 as quotient from lineitem""",
        "scaler_fit": scaler,
        "scaler_table": scaler,
        "saved_scaler": f"select * from ({scaler}) where feature <> 'template_id'",
        "threshold_percentile": "select round(quantile_cont(value, 0.95), 6) + 0.0 as threshold from events",
        "threshold_mad": mad,
        "threshold_iqr": """select round(quantile_cont(l_extendedprice, 0.75) + 1.5 * (quantile_cont(l_extendedprice, 0.75)
 - quantile_cont(l_extendedprice, 0.25)), 6) + 0.0 as threshold from lineitem""",
        "threshold_static": "select event_id, value > 100.0 as anomaly from events",
        "entropy": """with c as (select event_type, event_id % 37 as kind, count(*) as n from events group by 1, 2),
 q as (select event_type, n / sum(n) over (partition by event_type) as p from c)
 select event_type, round(-sum(p * log2(p)), 6) + 0.0 as entropy from q group by event_type""",
        "detection_stats": counters,
        "stream_stats": counters,
        "training_stats": f"""with {parsed()} select count(*) as total_logs, count(*) filter (where status > 0) as parsed_logs,
 count(*) filter (where status > 0) as feature_rows, {len(feature_names())} as feature_columns,
 'isolation_forest' as model_type, 'trained' as status from p""",
        "ip_path_distinct": f"with {parsed()} select ip, count(distinct path) as paths from p group by ip",
        "ip_frequency": f"with {parsed()}, {_stats('p')} select line_no, ip_frequency from s",
        "ip_path_diversity": f"with {parsed()}, {_stats('p')} select line_no, ip_path_diversity from s",
        "ip_request_rate": f"with {parsed()}, {_stats('p')} select line_no, round(ip_request_rate, 6) + 0.0 as ip_request_rate from s",
        "ip_statistics": f"""with {_dense()}, {_stats('dense')} select line_no, ip, ip_path_diversity, ip_frequency,
 round(ip_request_rate, 6) + 0.0 as ip_request_rate from s""",
        "stream_ip_statistics_stored": f"""with {_dense()}, {_stats('dense')} select line_no, ip, ip_path_diversity, ip_frequency,
 round(ip_request_rate, 6) + 0.0 as ip_request_rate from s""",
        "stream_ip_statistics": f"""with {parsed()}, {_stats('p')} select line_no, ip, ip_frequency, ip_path_diversity,
 round(ip_request_rate, 6) + 0.0 as ip_request_rate from s""",
        "moving_average": """select o_orderkey, round(case when count(*) over () < 5 then o_totalprice else
 avg(o_totalprice) over (order by o_orderkey rows between 4 preceding and current row) end, 4) + 0.0 as moving_average from orders""",
        "template_signatures": f"with {LOGS}, {_SIGNATURES} select template_id, signature as template, n, first_line_no from dictionary",
        "stream_templates": f"with {LOGS}, {_SIGNATURES} select template_id, signature, first_line_no from dictionary",
        "assign_templates": f"""with {LOGS}, {_SIGNATURES} select line_no, coalesce(template_id, -1) as template_id,
 coalesce(signature, '') as template from signed left join dictionary using (signature)""",
        "unseen_templates": f"""with {LOGS}, signed as (select line_no, ingest_ts, case when trim(line) <> '' then {_MASKED} end as signature from logs)
 select signature, count(*) as n, min(line_no) as first_line_no from signed where signature is not null
  and ingest_ts >= timestamp '2024-01-02' and signature not in
  (select signature from signed where signature is not null and ingest_ts < timestamp '2024-01-02') group by signature""",
        "scaler_transform": _scaled("where method_GET = 1"),
        "scaler_fit_transform": _scaled(),
        "detector_fit": f"""with {parsed()} select count(*) as total_logs, count(*) filter (where status > 0) as parsed_logs,
 count(*) filter (where status > 0) as feature_rows, {len(feature_names())} as feature_columns,
 'isolation_forest' as model_type, 'trained' as status from p""",
        "explain": _explain(),
        "result_record": f"""with {parsed()}, {_SIGNATURES} select p.line_no,
 concat(case when microsecond(wall_ts) % 1000000 = 0 then strftime(wall_ts, '%Y-%m-%d %H:%M:%S')
  else strftime(wall_ts, '%Y-%m-%d %H:%M:%S.%f') end, zone) as "timestamp", ip, method, path, status,
 coalesce(template_id, -1) as template_id from p join signed using (line_no) left join dictionary using (signature)""",
        "stream_ip_window": f"""with {parsed()}, starts as (select ip, event_us // 1000000 as sec, unnest(range(12)) as back from p)
 select cast((sec // 300 - back) * 300 as bigint) as window_start, ip, count(*) as requests from starts group by 1, 2""",
        "stream_ip_window_append": f"""with {parsed()}, starts as (select ip, event_us // 1000000 as sec, unnest(range(12)) as back from p),
 closed as (select (max(event_us) // 1000) * 1000 - 7200000000 as mark from p),
 w as (select cast((sec // 300 - back) * 300 as bigint) as window_start, ip, count(*) as requests from starts group by 1, 2)
 select w.* from w cross join closed where (window_start + 3600) * 1000000 <= mark""",
        "observed_stats": f"select total, anomalies from ({counters})",
        "stream_observed_stats": f"select total, anomalies from ({counters})",
        "parse_error_report": f"""with {parsed("nginx")}, e as (select line_no, case when trim(line) = '' then 'blank line'
  when parse_kind = 'empty' then 'format does not fit' when status not between 100 and 599 then 'status out of range' end as parse_error from p)
 select parse_error, count(*) as rows, min(line_no) as first_line_no from e where parse_error is not null group by parse_error""",
        "many_patterns": _many(),
        "stream_cutoff": "select count(*) as n, true as inside from events",
        "stream_dedup": f"with {LOGS} select distinct line from logs",
        "attack_categories": _attacks(),
        "ip_over_limit": f"with {_dense()}, {_stats('dense')} select ip, count(*) as requests from s where ip_frequency > 500 group by ip",
        # failures are 404 and 500 before the view turns them into 401 and 403
        "brute_force": f"""with {parsed()} select ip, (event_us // 3600000000) * 3600 as window_start, count(*) as failures
 from p where status in (404, 500) group by 1, 2 having count(*) > 1""",
    }
    return {name: " ".join(text.split("\n")) for name, text in sql.items()}
