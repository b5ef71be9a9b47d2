import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators.features import extract_features
from tidewatch.operators.parse import parse_logs

# Published example lines; what is expected of them was worked out by hand.
LINES = {
    "L1": '192.168.1.1 - - [01/Jan/2024:12:00:00 +0000] "GET /api/users HTTP/1.1" 200 1234 "-" "Mozilla/5.0"',
    "L2": '192.168.1.1 - - [01/Jan/2024:12:00:00 +0000] "GET /api/users HTTP/1.1" 200 1234',
    "L3": '192.168.1.2 - - [01/Jan/2024:12:00:01 +0000] "POST /api/login HTTP/1.1" 401 567',
    "L4": '192.168.1.1 - - [01/Jan/2024:12:00:00 +0000] "GET /admin/../../etc/passwd HTTP/1.1" 403 0 "-" "curl/7.68.0"',
    "L5": "invalid log line",
    "L6": "",
    "L7": '10.0.0.8 WARN "PUT /job/3 HTTP/1.1" 503 upstream',
    "L8": '10.0.0.8 WARN "PUT /job/3 HTTP/1.1" 503',
    "L9": '10.0.0.1 - - [01/Jan/2024:23:30:00 -0500] "GET /x HTTP/1.1" 404 -',
    "L10": '999.1.1.1 - - [01/Jan/2024:12:00:00 +0000] "GET / HTTP/1.1" 200 5',
    "L11": "OUTPUT failure",
}
INGEST = "2024-03-02 07:08:09"
EXPECTED = {
    "L1": ("combined", "192.168.1.1", "GET", "/api/users", 200, 1234, "2024-01-01 12:00:00", "Mozilla/5.0"),
    "L2": ("common", "192.168.1.1", "GET", "/api/users", 200, 1234, "2024-01-01 12:00:00", "-"),
    "L3": ("common", "192.168.1.2", "POST", "/api/login", 401, 567, "2024-01-01 12:00:01", "-"),
    "L4": ("combined", "192.168.1.1", "GET", "/admin/../../etc/passwd", 403, 0, "2024-01-01 12:00:00", "curl/7.68.0"),
    "L5": ("simple", "unknown", "GET", "/", 200, 0, INGEST, "-"),
    "L6": ("empty", "unknown", "GET", "/", 0, 0, INGEST, "-"),
    "L7": ("simple", "10.0.0.8", "PUT", "/job/3", 503, 0, INGEST, "-"),
    "L8": ("simple", "10.0.0.8", "PUT", "/job/3", 200, 0, INGEST, "-"),
    "L9": ("common", "10.0.0.1", "GET", "/x", 404, 0, "2024-01-02 04:30:00", "-"),
    "L10": ("common", "999.1.1.1", "GET", "/", 200, 5, "2024-01-01 12:00:00", "-"),
    "L11": ("simple", "unknown", "PUT", "/", 200, 0, INGEST, "-"),
}


def rows(df):
    when = F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss")
    out = df.select(
        "line_no", "parse_kind", "ip", "method", "path", "status", "size", when, "user_agent"
    ).collect()
    return {r[0]: tuple(r[1:]) for r in out}


def test_auto(logs_of):
    found = rows(parse_logs(logs_of(LINES.values())))
    for i, name in enumerate(LINES):
        assert found[i] == EXPECTED[name], name


def test_classes_are_unicode(logs_of):
    digits = str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")
    lines = [
        "10.0.0.8 WARN \"GÉT /a/b HTTP/1.1\" ٥٠٣ upstream",
        LINES["L2"].translate(digits),
        LINES["L10"].replace("200", "४०४"),
    ]
    found = rows(parse_logs(logs_of(lines)))
    assert found[0] == ("simple", "10.0.0.8", "GET", "/a/b", 503, 0, INGEST, "-")
    kind, ip, method, path, status, size, _, agent = found[1]
    assert (kind, ip, status, size) == ("common", "192.168.1.1".translate(digits), 200, 1234)
    assert found[2][4] == 404


def test_custom_classes_are_unicode(logs_of):
    pattern = r"(?P<ip>[\d.]+) (?P<user>\w+) (?P<status>\d+)\s(?P<path>[^\w\s]\S+)"
    found = parse_logs(logs_of(["١٠.٠.٠.١ Zoë ٤٠٤\u3000/né x", "1.2.3.4 a-b 200 /x"]), "custom", pattern=pattern)
    got = [tuple(r) for r in found.orderBy("line_no").select("user", "status", "path").collect()]
    assert got == [("Zoë", 404, "/né"), ("-", 0, "/")]
    assert S.unicode_pattern(r"[]\d]\\d\W") == r"[\]\p{Nd}]\\d[^\p{L}\p{N}_]"


def test_strict_format_gives_empty_row(logs_of):
    found = rows(parse_logs(logs_of(LINES.values()), "apache_combined"))
    for i, name in enumerate(LINES):
        if name in ("L1", "L4"):
            assert found[i] == EXPECTED[name]
        else:
            assert found[i] == ("empty", "unknown", "GET", "/", 0, 0, INGEST, "-")


def test_nginx_wants_numeric_size(logs_of):
    dash = LINES["L1"].replace("1234", "-")
    found = rows(parse_logs(logs_of([LINES["L1"], dash, LINES["L2"]]), "nginx"))
    assert [found[i][0] for i in range(3)] == ["combined", "empty", "empty"]


def test_common_ignores_the_tail(logs_of):
    found = rows(parse_logs(logs_of([LINES["L1"]]), "common"))
    assert found[0] == EXPECTED["L2"]


def test_other_format_is_the_fallback(logs_of):
    found = rows(parse_logs(logs_of([LINES["L1"], ""]), "whatever"))
    assert found[0] == ("simple", "192.168.1.1", "GET", "/api/users", 200, 0, INGEST, "-")
    assert found[1][0] == "empty"


def test_custom_pattern(logs_of):
    pattern = r'(?P<ip>[\d\.]+) .* "(?P<method>\S+) (?P<path>\S+).*" (?P<status>\d+)'
    found = rows(parse_logs(logs_of([LINES["L7"], LINES["L5"]]), "custom", pattern))
    assert found[0][:5] == ("custom", "10.0.0.8", "PUT", "/job/3", 503)
    assert found[1][0] == "empty"
    with pytest.raises(ValueError):
        parse_logs(logs_of([]), "custom")


def test_odd_lines(logs_of):
    mark = LINES["L1"].replace("users", "us\x01ers")
    trailing = LINES["L2"] + ' "-" unquoted'
    empty_tail = LINES["L2"] + ' "" ""'
    wide = LINES["L2"].replace(" 200 ", " 99999999999999999999 ").replace("1234", "1_000")
    found = rows(parse_logs(logs_of([mark, trailing, empty_tail, wide, " \t", "a\x01b"])))
    assert found[0][:4] == ("combined", "192.168.1.1", "GET", "/api/us\x01ers")
    assert found[1][0] == "common"
    assert found[2] == ("combined", *EXPECTED["L2"][1:7], "")
    assert found[3][4] == 2**63 - 1 and found[3][5] == 1000
    assert found[4][0] == "empty"
    assert found[5][0] == "simple"


@pytest.mark.parametrize(
    "text, valid",
    [
        ("1.2.3.4", True),
        ("255.255.255.255", True),
        ("256.1.1.1", False),
        ("1.2.3", False),
        ("1.2.3.4.5", False),
        ("+1.02.003.-0", True),
        ("-1.2.3.4", False),
        ("1_0.2.3.4", True),
        ("1._2.3.4", False),
        ("1.2.3.x", False),
        ("1..2.3", False),
    ],
)
def test_is_ipv4(spark, text, valid):
    assert spark.range(1).select(S.is_ipv4(F.lit(text))).first()[0] is valid


def test_times(logs_of):
    stamps = {
        "2024-02-03 04:05:06": "2024-02-03 04:05:06",
        "3/feb/2024:4:5:6": "2024-02-03 04:05:06",
        "03/Feb/2024:04:05:06 +02:00": "2024-02-03 02:05:06",
        "03/Feb/2024:04:05:06 Z": "2024-02-03 04:05:06",
        "31/Feb/2024:04:05:06 +0000": INGEST,
        "03/Feb/2024 04:05:06": INGEST,
        "03/Feb/2024:04:05:06+0000": INGEST,
    }
    lines = [LINES["L2"].replace("01/Jan/2024:12:00:00 +0000", s) for s in stamps]
    found = rows(parse_logs(logs_of(lines)))
    assert [found[i][6] for i in range(len(lines))] == list(stamps.values())


def test_filter_does_not_repeat_the_match(logs_of):
    plan = parse_logs(logs_of([])).filter("status > 0").select("ip")._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("Generate inline") == 1
    below = plan.toString().split("Generate inline")[1]
    assert "Filter" not in below


FEATURES = {
    "L1": (1, 0, 0, 10, 0, "GET", 12, 0, 693),
    "L2": (1, 0, 0, 10, 0, "GET", 12, 0, 0),
    "L3": (0, 1, 0, 10, 0, "POST", 12, 0, 0),
    "L4": (0, 1, 0, 23, 2, "GET", 12, 0, 8006),
    "L5": (1, 0, 0, 1, 0, "GET", 7, 5, 0),
    "L6": (0, 0, 0, 1, 0, "GET", 7, 5, 0),
    "L9": (0, 1, 0, 2, 0, "GET", 23, 0, 0),
}


def test_features(logs_of):
    for r in extract_features(parse_logs(logs_of(LINES.values()))).collect():
        name = list(LINES)[r["line_no"]]
        if name not in FEATURES:
            continue
        *numbers, method, hour, weekday, agent = FEATURES[name]
        found = [r[c] for c in ("status_2xx", "status_4xx", "status_5xx", "path_length", "suspicious_score")]
        assert found == numbers, name
        assert r[f"method_{method}"] == 1 and sum(v for k, v in r.asDict().items() if k.startswith("method_")) == 1
        assert (r["hour"], r["weekday"], r["user_agent_hash"]) == (hour, weekday, agent), name


def test_disabled_features_are_absent(logs_of):
    found = extract_features(parse_logs(logs_of([""])), ["path_length", "status_code_category"])
    assert found.columns == ["line_no", "status_2xx", "status_4xx", "status_5xx", "path_length"]
    with pytest.raises(ValueError):
        extract_features(parse_logs(logs_of([""])), ["no_such_group"])


def test_classes_that_ask_for_ascii_first_are_the_white_space_ones(spark):
    codes = [c for c in [*range(0x3100), 0xFEFF, 0x1F600] if c]
    rows = spark.createDataFrame([(c, chr(c)) for c in codes], "code int, c string")
    found = rows.select("code", F.col("c").rlike(f"^{S.SPACES}$").alias("space"), F.col("c").rlike(f"^{S.NO_SPACE}$").alias("other"))
    for r in found.collect():
        assert r.space == (chr(r.code) in S.SPACE_CHARACTERS) and r.other == (not r.space), hex(r.code)


def test_stored_row_features_are_read_instead_of_parsing_again(spark, logs_of):
    lines = [f'10.0.0.{i % 3} - - [02/Mar/2024:07:08:{i % 60:02d} +0000] "GET /a/{i % 5} HTTP/1.1" 200 {i}' for i in range(50)]
    parsed = parse_logs(logs_of(lines)).filter("status > 0")
    stored, plain = extract_features(parsed, stored=True), extract_features(parsed)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, plain.collect()))
    shown = [d._jdf.queryExecution().optimizedPlan().toString().lower() for d in (stored, plain)]
    assert "regexp" not in shown[0] and "regexp" in shown[1]
