"""Sites for the crawl's tests, in place of the network."""

import threading
import time

LOCK = threading.Lock()


def slow_sites(url, config):
    """slow*.com take a while for each answer; every site has a contact page, and robots rules that close /private."""
    host = url.split("/")[2]
    if host.startswith("slow"):
        time.sleep(1.0)
    if url.endswith("/robots.txt"):
        return url, 200, "text/plain", b"User-agent: *\nDisallow: /private\n"
    if "broken" in host:
        raise OSError("no route")
    return url, 200, "text/html; charset=utf-8", f"<title>{host}</title><a href='/contact'>Contact</a><a href='/private/contact'>Contact</a><p>info@{host}".encode()
