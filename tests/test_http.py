import hashlib
import http.server
import io
import random
import threading

import pytest

from tallow.model import BannedError, NotAvailableError, RateLimitedError, TallowError
from tallow.sources.http import Limiter, Policy, Response, get, get_patiently, retry_after, save


def run(*answers, **more):
    left, slept = list(answers), []

    def transport(what):
        r = left.pop(0)
        if isinstance(r, Exception):
            raise r
        return r

    return lambda: get(transport, "k", sleep=slept.append, clock=lambda: 1000.0, rng=random.Random(1), **more), slept, left


def test_retries_then_answers():
    call, slept, _ = run(Response(500), OSError("cut"), Response(429, headers={"Retry-After": "7"}), Response(200, b"x"))
    assert call() == b"x" and len(slept) == 3 and slept[0] <= 0.5 and slept[1] <= 1 and slept[2] == 7


@pytest.mark.parametrize(("status", "error", "left"), [(404, NotAvailableError, 3), (418, BannedError, 3), (429, RateLimitedError, 0), (503, TallowError, 0), (400, TallowError, 3)])
def test_failures(status, error, left):
    call, _, rest = run(*[Response(status)] * 4)
    with pytest.raises(error):
        call()
    assert len(rest) == left


def test_retry_after():
    assert retry_after("5", 0) == 5 and retry_after(None, 0) is None and retry_after("soon", 0) is None
    assert retry_after("Thu, 01 Jan 1970 00:01:00 GMT", 50) == 10 and retry_after("Thu, 01 Jan 1970 00:01:00 GMT", 99) == 0


def test_limiter_and_policy():
    now, slept = [0.0], []
    own = Limiter(40, 20, clock=lambda: now[0], sleep=slept.append)
    for _ in range(12):
        own.take()
    assert slept == [pytest.approx(0.05), pytest.approx(0.1)]
    assert [Policy().bound(i) for i in range(1, 7)] == [0.5, 1, 2, 4, 8, 8]
    with pytest.raises(ValueError):
        Limiter(0)


def test_pauses():
    answers, slept = [Response(429)] * 4 + [Response(200, b"y")], []
    assert get_patiently(lambda w: answers.pop(0), "k", pause=99, sleep=slept.append, rng=random.Random(1)) == b"y" and slept[-1] == 60
    calls = []
    with pytest.raises(RateLimitedError):
        get_patiently(lambda w: (calls.append(w), Response(429))[1], "k", sleep=lambda s: None)
    assert len(calls) == 12
    calls.clear()
    with pytest.raises(BannedError):
        get_patiently(lambda w: (calls.append(w), Response(418))[1], "k", sleep=lambda s: None)
    assert len(calls) == 1


def broken(*parts):
    yield from parts
    raise OSError("reset")


def test_bodies_that_break_off():
    whole = Response(200, b"abcdef", {"Content-Length": "6"})
    short = Response(200, b"abc", {"Content-Length": "6"})
    call, slept, left = run(short, Response(200, parts=broken(b"ab")), whole)
    assert call() == b"abcdef" and len(slept) == 2 and not left
    with pytest.raises(TallowError, match="3 bytes of 6"):
        run(*[short] * 4)[0]()
    assert run(Response(200, b"abc", {"Content-Length": "6", "Content-Encoding": "gzip"}))[0]() == b"abc"
    assert run(Response(200, b"abc", {"content-length": "no"}))[0]() == b"abc" and run(Response(200, b"", {"content-length": "0"}))[0]() == b""


def test_save_starts_anew():
    answers = [Response(200, parts=broken(b"wrong and longer")), Response(500), Response(200, parts=iter([b"ab", b"", b"cd"]), headers={"Content-Length": "4"})]
    f = io.BytesIO(b"head")
    f.seek(4)
    assert save(lambda what: answers.pop(0), "k", f, sleep=lambda s: None) == hashlib.sha256(b"abcd").hexdigest()
    assert f.getvalue() == b"headabcd"
    with pytest.raises(NotAvailableError):
        save(lambda what: Response(404), "k", f)


def test_full_disk_is_no_broken_connection():
    class Full(io.BytesIO):
        def write(self, b):
            raise OSError("no space")

    asked = []
    with pytest.raises(OSError, match="no space"):
        save(lambda what: asked.append(what) or Response(200, b"x"), "k", Full())
    assert len(asked) == 1


def test_command_lines_transport():
    from tallow.cli import PIECE, _Base

    big = random.Random(3).randbytes(PIECE + 10)

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            code, body, says = {"/big": (200, big, len(big)), "/short": (200, b"abc", 6), "/none": (404, b"gone", 4)}[self.path]
            self.send_response(code)
            self.send_header("Content-Length", str(says))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = _Base(f"http://127.0.0.1:{server.server_port}/")
        assert get(base, "big") == big
        f = io.BytesIO()
        assert save(base, "big", f) == hashlib.sha256(big).hexdigest() and f.getvalue() == big
        with pytest.raises(TallowError, match="short"):
            get(base, "short", Policy(2, 0.0, 0.0))
        with pytest.raises(NotAvailableError):
            get(base, "none")
    finally:
        server.shutdown()
        server.server_close()
