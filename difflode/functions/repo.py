"""Canonical forms of repository names, commit ids and split names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_repo(col: Column) -> Column:
    """``owner/name`` in lower case, or null where there is no repository.

    Addresses (``https://host/o/n.git``, ``git@host:o/n``, ``host/o/n``), trailing
    slashes, ``owner__name`` and stray white space all give the same name: the last
    two path parts count. A text without two parts is kept as it is (lower case).
    """
    s = F.lower(F.regexp_replace(col, r"^[\s\p{Z}\p{Cc}\p{Cf}/\\]+|[\s\p{Z}\p{Cc}\p{Cf}/\\]+$", ""))
    s = F.regexp_replace(s, r"[?#].*$", "")
    s = F.regexp_replace(s, r"\.git$", "")
    s = F.when(s.rlike(r"[/\\:]"), s).otherwise(F.regexp_replace(s, r"^([^_]+(?:_[^_]+)*)__(.+)$", "$1/$2"))
    s = F.regexp_replace(s, r"^(?:.*[/\\:])?([^/\\:]+)[/\\:]+([^/\\:]+)$", "$1/$2")
    return F.when(s != "", s)


def canonical_sha(col: Column) -> Column:
    """A commit id in lower case without white space; null where blank."""
    s = F.lower(F.trim(col))
    return F.when(s != "", s)


def canonical_split(col: Column) -> Column:
    """``train``, ``dev`` or ``test``; null where blank; any other name in lower case."""
    s = F.regexp_replace(F.lower(col), r"[^a-z]+", "")
    return (
        F.when(s.isin("train", "training", "trainset", "trn", "tr"), "train")
        .when(s.isin("dev", "devel", "development", "devset", "val", "valid", "validation", "validate", "valset"), "dev")
        .when(s.isin("test", "testing", "testset", "tst", "finaltest", "testfinal", "final", "heldouttest"), "test")
        .when(s != "", s)
    )
