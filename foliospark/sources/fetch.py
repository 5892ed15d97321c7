"""The URL source: pages and files over HTTP, never from inside the network."""

from __future__ import annotations

import http.client
import ipaddress
import socket
import ssl
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes beyond which a download is refused, and redirects that are followed.
MAX_BYTES, MAX_REDIRECTS = 512 << 20, 10
#: Media types and the endings of their extractors.
MEDIA = {
    "text/html": "html", "application/xhtml+xml": "html", "text/plain": "txt", "text/markdown": "md", "text/csv": "csv", "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "image/png": "png", "image/jpeg": "jpg", "image/tiff": "tiff", "image/gif": "gif", "image/bmp": "bmp",
}


class Refused(ValueError):
    """A URL that is not fetched."""


def public_addresses(host: str, port: int, resolve=socket.getaddrinfo) -> list[str]:
    """Addresses of a host, all of which are public; one that is not refuses the host. Numbers in any notation that the
    resolver reads are judged as the addresses they stand for."""
    try:
        found = list(dict.fromkeys(a[4][0] for a in resolve(host, port, type=socket.SOCK_STREAM)))
    except OSError as e:
        raise Refused(f"{host} has no address: {e}") from e
    for a in found:
        ip = ipaddress.ip_address(a.split("%")[0])
        mapped = getattr(ip, "ipv4_mapped", None) or getattr(ip, "sixtofour", None)
        if not ip.is_global or ip.is_multicast or (mapped is not None and not mapped.is_global):
            raise Refused(f"{host} is inside the network ({a})")
    return found


def _get(url: str, timeout: float, most: int, check) -> tuple[int, dict[str, str], bytes]:
    """One request, to the very address that was checked."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise Refused(f"{url} is no web address")
    port = parts.port or (443 if parts.scheme == "https" else 80)
    address = check(parts.hostname, port)[0]
    sock = socket.create_connection((address, port), timeout)
    if parts.scheme == "https":
        sock = ssl.create_default_context().wrap_socket(sock, server_hostname=parts.hostname)
    link = http.client.HTTPConnection(parts.hostname, port, timeout=timeout)
    link.sock = sock
    try:
        link.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"User-Agent": "foliospark", "Accept": "*/*"})
        reply = link.getresponse()
        body = reply.read(most + 1)
        if len(body) > most:
            raise Refused(f"{url} is larger than {most} bytes")
        return reply.status, {k.lower(): v for k, v in reply.getheaders()}, body
    finally:
        link.close()


def fetch_url(url: str, timeout: float = 60.0, most: int = MAX_BYTES, redirects: int = MAX_REDIRECTS, check=public_addresses) -> tuple[bytes, str]:
    """(content, ending for its extractor). Each hop of a redirect is checked like the first."""
    for _ in range(redirects + 1):
        status, headers, body = _get(url, timeout, most, check)
        if status in (301, 302, 303, 307, 308) and headers.get("location"):
            url = urljoin(url, headers["location"])
            continue
        if status != 200:
            raise OSError(f"{url} answers {status}")
        tail = urlsplit(url).path.rsplit("/", 1)[-1]
        named = tail.rsplit(".", 1)[-1].lower() if "." in tail else ""
        return body, MEDIA.get(headers.get("content-type", "").split(";")[0].strip().lower(), named or "html")
    raise Refused(f"more than {redirects} redirects")


def fetch(urls: DataFrame, column: str = "url", partitions: int | None = None, check=public_addresses) -> DataFrame:
    """path, content, error of each distinct URL; path ends with its extractor's ending, as ``extract`` wants it. A
    failed fetch is a row with an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for url in pdf.url:
                try:
                    body, ending = fetch_url(url, check=check)
                    rows.append((url if url.lower().endswith(f".{ending}") else f"{url}#.{ending}", body, None))
                except Exception as e:  # the contract: errors are values of the row
                    rows.append((url, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    todo = urls.select(F.col(column).alias("url")).filter("url is not null").distinct()
    todo = todo.repartition(partitions, "url") if partitions else todo
    return todo.mapInPandas(run, "path string, content binary, error string")
