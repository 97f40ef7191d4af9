"""A web made up for tests, importable by workers."""

from factloom.sources.web import TlsError, TransportError

CALLS: list[str] = []


def transport(url: str) -> tuple[int, str, bytes]:
    CALLS.append(url)
    if url.endswith("/robots.txt"):
        return (200, "text/plain", b"User-agent: *\nDisallow: /secret") if "strict" in url else (404, "", b"")
    if "tls" in url:
        raise TlsError("bad certificate")
    if "down" in url:
        raise TransportError("no answer")
    return 200, "text/html", f"<p>{url}</p>".encode()


def fallback(url: str) -> tuple[int, str, bytes]:
    return 200, "text/html", b"by the other way"


def index(url: str) -> list[str]:
    CALLS.append(url)
    if "busy" in url:
        return ["20250102000000"] if CALLS.count(url) >= 3 else []
    if "broken" in url:
        raise TransportError("429")
    return ["20240101000000", "20250101000000"] if "known" in url else []
