"""Domains of e-mail addresses and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text

#: Public suffixes of two labels; any other suffix is taken to have one.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "org.au", "net.au", "gov.au", "co.nz", "org.nz", "co.jp", "com.br", "com.mx", "co.in", "co.za", "k12.il.us", "state.il.us", "cook.il.us")


def url_host(c: Column) -> Column:
    """Host of a URL without user, port, surrounding dots and www.; without a scheme, http is taken."""
    own = clean_text(c)
    rest = F.regexp_replace(own, r"^[a-z][a-z0-9+.-]*://|^//", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*", 0), r"^.*@", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r":\d*$", ""), r"^\.+|\.+$", ""), r"^www\.", "")
    return F.nullif(host, F.lit(""))


def email_domain(c: Column) -> Column:
    """What follows the last @ of an address that has a local part."""
    own = F.regexp_replace(clean_text(c), r"^mailto:", "")
    return F.nullif(F.regexp_replace(F.regexp_extract(own, r"^.+@([^@]+)$", 1), r"^\.+|\.+$|[?>].*$", ""), F.lit(""))


def extract_domain(c: Column) -> Column:
    return F.when(F.contains(clean_text(c), F.lit("@")), email_domain(c)).otherwise(url_host(c))


def contact_domains(emails: Column, websites: Column) -> Column:
    both = F.concat(F.coalesce(emails, F.array().cast("array<string>")), F.coalesce(websites, F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(both, extract_domain), lambda x: x.isNotNull())))


def registered_domain(host: Column) -> Column:
    """The public suffix and one label; hosts of one label and IPv4 addresses stay whole."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")
    three = F.array_join(F.slice(labels, F.greatest(n - 2, F.lit(1)), F.lit(3)), ".")
    return F.when(F.regexp_like(host, F.lit(r"^\d+(\.\d+){3}$")) | (n < 3), host).when(two.isin(*SUFFIXES), three).otherwise(two)


def domain_tokens(emails: Column, websites: Column) -> Column:
    """host, registered domain and has_path of each contact; only websites have paths."""

    def token(host: Column, path: Column) -> Column:
        return F.struct(host.alias("host"), registered_domain(host).alias("site"), path.alias("has_path"))

    mail = F.transform(F.coalesce(emails, F.array().cast("array<string>")), lambda x: token(email_domain(x), F.lit(False)))
    web = F.transform(F.coalesce(websites, F.array().cast("array<string>")), lambda x: token(url_host(x), F.regexp_like(F.regexp_replace(clean_text(x), r"^[a-z][a-z0-9+.-]*://|^//", ""), F.lit(r"^[^/?#]*/[^?#]"))))
    return F.array_distinct(F.filter(F.concat(mail, web), lambda x: x["host"].isNotNull()))


def domain_overlap(left: Column, right: Column) -> Column:
    """The best of all pairs of tokens: 1.0 same host without a path, 0.8 same host, 0.4 same registered domain, 0."""

    def tier(a: Column, b: Column) -> Column:
        same = a["host"] == b["host"]
        return F.when(same & ~a["has_path"] & ~b["has_path"], 1.0).when(same, 0.8).when(a["site"] == b["site"], 0.4).otherwise(0.0)

    return F.coalesce(F.array_max(F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: tier(a, b))))), F.lit(0.0))
