"""P1-P9, F1 on hand-written trace lines (no traces ship with the reference)."""

import pytest

from tessera.functions.trace import parse_trace_lines

LINES = [
    (1, '1234  07:56:16.206908 read(3, "ab", 2) = 2 <0.0001>'),
    (2, '1720623123.456789 openat(AT_FDCWD, "/x/a.txt", O_RDONLY) = 3'),
    (3, "77 07:56:16.2 <... read resumed>) = 5"),
    (4, "77 07:56:16.3 mmap(NULL, 8192, PROT) = 0x7f00"),
    (5, "77 07:56:16.4 +++ exited with 0 +++"),
    (6, '77 07:56:16.5 connect(3, {sa_family=AF_INET, sin_port=htons(53), '
        'sin_addr=inet_addr("1.1.1.1")}, 16) = -1 EINPROGRESS'),
    (7, "77 07:56:16.6 read(3,  <unfinished ...>"),
    (8, '77 07:56:16.7 read(5, "/dev/urandom", 32) = 32'),
    (9, '77 07:56:16.8 pwrite64(5, "x", 1, 0) = 1'),
    (10, "77 07:56:16.9 futex(0x1, FUTEX_WAIT, 1) = 0"),
    (11, "77 07:56:15.0 close(3) = 0"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame(LINES, "line_order long, line string")
    return {r.line_order: r for r in parse_trace_lines(df).collect()}


def test_dropped_lines(parsed):
    assert 3 not in parsed and 5 not in parsed
    assert len(parsed) == 9


def test_wall_clock_and_pid(parsed):
    r = parsed[1]
    assert r.pid == 1234 and r.syscall == "read" and r.ret == 2 and r.clock == "wall"
    assert r.ts_s == pytest.approx(7 * 3600 + 56 * 60 + 16.206908, abs=1e-9)


def test_epoch_and_target_extension(parsed):
    r = parsed[2]
    assert r.pid is None and r.clock == "epoch" and r.ts_s == 1720623123.456789
    assert r.path == "/x/a.txt" and r.target_ext is True


def test_hex_return_and_mmap_length(parsed):
    r = parsed[4]
    assert r.ret == 0 and r.mmap_len == 8192


def test_connect_fields(parsed):
    r = parsed[6]
    assert r.ip == "1.1.1.1" and r.port == "53" and r.ret == -1


def test_unfinished_kept_with_zero(parsed):
    assert parsed[7].ret == 0 and parsed[7].syscall == "read"


def test_random_and_futex(parsed):
    assert parsed[8].is_random and parsed[8].ret == 32
    assert parsed[10].futex_wait
    assert parsed[9].syscall == "pwrite64"


def test_tab_indented_and_odd_clocks(spark):
    rows = [(0, "\t123 10.5 read(3) = 4"), (1, "  7 09:08:07.250 write(1) = 2"), (2, "\t 10.25 open(\"a\") = 3"), (3, "not a line")]
    got = {r.line_order: r for r in parse_trace_lines(spark.createDataFrame(rows, "line_order long, line string")).collect()}
    assert set(got) == {0, 1, 2}
    assert (got[0].pid, got[0].ts_s, got[0].syscall, got[0].ret) == (123, 10.5, "read", 4)
    assert (got[1].clock, got[1].ts_s) == ("wall", 9 * 3600 + 8 * 60 + 7.25)
    assert got[2].pid is None and got[2].path == "a"
