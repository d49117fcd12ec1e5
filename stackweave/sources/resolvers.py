"""Remote metadata: which resolver answers for what, retries, a cache, and the merge of answers.

The fetch function is a parameter, so that everything runs without a network.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import _record

# Limits of remote calls and of the cache.
ATTEMPTS, PAUSE_S, CACHE_DAYS = 2, 0.5, 30
# Which resolvers are asked for a kind of identifier, in order; isbn has none.
ORDER = {"doi": ("crossref", "semantic_scholar", "openalex"), "pmid": ("pubmed", "semantic_scholar"), "pmcid": ("pubmed",), "openalex": ("openalex",), "isbn": ()}


class NotFound(LookupError):
    pass


class Malformed(ValueError):
    pass


class Unavailable(ConnectionError):
    pass


Fetch = Callable[[str], tuple[int, str]]


def fetch_json(fetch: Fetch, url: str, pause: float = PAUSE_S) -> dict:
    """A JSON answer: two attempts, a pause after transport and JSON errors, none after 5xx; 404 and other 4xx end it."""
    error: Exception = Unavailable(url)
    for n in range(ATTEMPTS):
        try:
            status, body = fetch(url)
        except OSError as e:
            error = Unavailable(str(e))
        else:
            if status == 404:
                raise NotFound(url)
            if 400 <= status < 500:
                raise Unavailable(f"{url}: {status}")
            if status >= 500:
                error = Unavailable(f"{url}: {status}")
                continue
            try:
                return json.loads(body)
            except ValueError as e:
                error = Malformed(str(e))
        if n + 1 < ATTEMPTS:
            time.sleep(pause)
    raise error


def _identifiers(**found) -> list[dict]:
    return [{"namespace": k, "value": v} for k, v in found.items() if v]


def crossref(fetch: Fetch, kind: str, value: str) -> dict:
    m = fetch_json(fetch, f"https://api.crossref.org/works/{value}").get("message") or {}
    if not m:
        raise Malformed("no message")
    year = next((int(p[0][0]) for k in ("published-print", "published-online", "issued") if (p := (m.get(k) or {}).get("date-parts")) and p[0] and p[0][0]), None)
    names = [", ".join(x for x in (a.get("family"), a.get("given")) if x) for a in m.get("author", [])]
    kinds = {"journal-article": "article", "proceedings-article": "article", "book": "book", "book-chapter": "chapter"}
    return _record("Crossref", external_id=m.get("DOI"), external_identifiers=_identifiers(doi=(m.get("DOI") or "").lower(), issn=(m.get("ISSN") or [None])[0], isbn=(m.get("ISBN") or [None])[0]), title=(m.get("title") or [""])[0], authors=[n for n in names if n], published_year=year, item_type=kinds.get(m.get("type"), "other"), abstract_text=re.sub("<[^>]+>", "", m.get("abstract") or ""), pages=m.get("page") or "", volume=m.get("volume") or "", raw_fields={"container_title": (m.get("container-title") or [""])[0]})


def pubmed(fetch: Fetch, kind: str, value: str) -> dict:
    """PubMed's summary of a PMID, else Europe PMC's search; PMCIDs go to the search."""
    if kind == "pmid":
        try:
            r = (fetch_json(fetch, f"https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esummary.fcgi?db=pubmed&retmode=json&id={value}").get("result") or {}).get(value)
            if r and "error" not in r:
                ids = {i.get("idtype"): i.get("value") for i in r.get("articleids", [])}
                year = r.get("pubdate", "")[:4]
                return _record("PubMed", external_id=value, external_identifiers=_identifiers(pmid=value, doi=(ids.get("doi") or "").lower(), pmcid=(ids.get("pmc") or "").removeprefix("PMC"), issn=r.get("issn")), title=r.get("title", ""), authors=[a["name"] for a in r.get("authors", []) if a.get("name")], published_year=int(year) if year.isdigit() else None, item_type="article", pages=r.get("pages", ""), volume=r.get("volume", ""), raw_fields={"journal": r.get("fulljournalname", "")})
        except (Malformed, Unavailable):
            pass
    query = f"EXT_ID:{value}" if kind == "pmid" else f"PMCID:PMC{value}"
    found = (fetch_json(fetch, f"https://www.ebi.ac.uk/europepmc/webservices/rest/search?format=json&query={query}").get("resultList") or {}).get("result") or []
    if not found:
        raise NotFound(value)
    r = found[0]
    year = str(r.get("pubYear", ""))
    return _record("Europe PMC", external_id=r.get("pmid") or r.get("pmcid"), external_identifiers=_identifiers(pmid=r.get("pmid"), doi=(r.get("doi") or "").lower(), pmcid=(r.get("pmcid") or "").removeprefix("PMC")), title=r.get("title", ""), authors=[a.strip().rstrip(".") for a in (r.get("authorString") or "").split(", ") if a.strip()], published_year=int(year) if year.isdigit() else None, item_type="article", pages=r.get("pageInfo") or "", volume=r.get("journalVolume") or "", raw_fields={"journal": r.get("journalTitle") or ""})


def semantic_scholar(fetch: Fetch, kind: str, value: str) -> dict:
    r = fetch_json(fetch, f"https://api.semanticscholar.org/graph/v1/paper/{kind.upper()}:{value}?fields=title,authors,year,publicationDate,externalIds,abstract,journal,publicationTypes")
    if not r.get("paperId"):
        raise NotFound(value)
    ids = r.get("externalIds") or {}
    date = (r.get("publicationDate") or "")[:4]
    journal = r.get("journal") or {}
    types = r.get("publicationTypes") or []
    return _record("Semantic Scholar", external_id=r["paperId"], external_identifiers=_identifiers(doi=(ids.get("DOI") or "").lower(), pmid=ids.get("PubMed"), pmcid=ids.get("PubMedCentral")), title=r.get("title") or "", authors=[a["name"] for a in r.get("authors", []) if a.get("name")], published_year=r.get("year") or (int(date) if date.isdigit() else None), item_type="article" if "JournalArticle" in types or "Conference" in types else "book" if "Book" in types else "other", abstract_text=r.get("abstract") or "", pages=(journal.get("pages") or "").strip(), volume=journal.get("volume") or "", raw_fields={"journal": journal.get("name") or ""})


def openalex(fetch: Fetch, kind: str, value: str) -> dict:
    r = fetch_json(fetch, f"https://api.openalex.org/works/{value if kind == 'openalex' else f'doi:{value}'}")
    if not r.get("id"):
        raise NotFound(value)
    words = sorted((p, w) for w, places in (r.get("abstract_inverted_index") or {}).items() for p in places)
    biblio, source = r.get("biblio") or {}, (r.get("primary_location") or {}).get("source") or {}
    names = [(a.get("author") or {}).get("display_name") for a in r.get("authorships", [])]
    doi = re.sub("^https?://doi.org/", "", r.get("doi") or "").lower()
    return _record("OpenAlex", external_id=r["id"].rsplit("/", 1)[-1], external_identifiers=_identifiers(openalex=r["id"].rsplit("/", 1)[-1], doi=doi, issn=source.get("issn_l")), title=r.get("title") or "", authors=[n for n in names if n], published_year=r.get("publication_year"), item_type=r.get("type") if r.get("type") in ("article", "book", "chapter") else "other", abstract_text=" ".join(w for _, w in words), pages="-".join(p for p in (biblio.get("first_page"), biblio.get("last_page")) if p), volume=biblio.get("volume") or "", raw_fields={"container_title": source.get("display_name") or ""})


RESOLVERS = {"crossref": crossref, "pubmed": pubmed, "semantic_scholar": semantic_scholar, "openalex": openalex}


def merge(records: list[dict]) -> dict:
    """One record of several: blanks filled in order, identifiers joined, names by `` + ``."""
    out = {k: (list(v) if isinstance(v, list) else dict(v) if isinstance(v, dict) else v) for k, v in records[0].items()}
    for r in records[1:]:
        for k in ("title", "abstract_text", "pages", "volume", "external_id"):
            if not (out[k] or "").strip():
                out[k] = r[k]
        for k in ("authors", "keywords"):
            out[k] = out[k] or list(r[k])
        out["published_year"] = out["published_year"] if out["published_year"] is not None else r["published_year"]
        out["item_type"] = r["item_type"] if out["item_type"] == "other" else out["item_type"]
        known = {(i["namespace"], i["value"].lower()) for i in out["external_identifiers"]}
        out["external_identifiers"] += [i for i in r["external_identifiers"] if (i["namespace"], i["value"].lower()) not in known]
        for k, v in r["raw_fields"].items():
            if not (out["raw_fields"].get(k) or "").strip():
                out["raw_fields"][k] = v
    container = out["raw_fields"].get("container_title") or out["raw_fields"].get("journal")
    if container:
        out["raw_fields"] |= {"container_title": container, "journal": container}
    out["source_name"] = " + ".join(dict.fromkeys(r["source_name"] for r in records))
    return out


@dataclass
class Registry:
    fetch: Fetch
    enabled: set[str] = field(default_factory=lambda: set(RESOLVERS))

    def resolve_best(self, kind: str, value: str) -> dict:
        """The merged answers of all resolvers for a kind; one success is enough.  Errors: not found before malformed before unavailable."""
        found, errors = [], []
        for name in ORDER[kind]:
            if name in self.enabled:
                try:
                    found.append(RESOLVERS[name](self.fetch, kind, value))
                except (NotFound, Malformed, Unavailable) as e:
                    errors.append(e)
        if found:
            return merge(found)
        for c in (NotFound, Malformed, Unavailable):
            for e in errors:
                if isinstance(e, c):
                    raise e
        raise NotFound(f"no resolver for {kind}:{value}")


def cache_key(identifier: Column) -> Column:
    return F.sha2(identifier, 256)


def fresh(cached: DataFrame, now: Column, at: str = "cached_at", days: int = CACHE_DAYS) -> DataFrame:
    """Cache rows that are not too old and not from the future."""
    return cached.where(F.col(at).between(now - F.expr(f"interval {days} days"), now))
