"""Schemas and options shared by all parts."""

from __future__ import annotations

from dataclasses import dataclass

#: Event types, and how many genes an event keeps. Fixed values.
ASE_TYPES = ("SE", "A3SS", "A5SS", "RI", "NSE")
SPAN = "array<struct<s:bigint,e:bigint>>"
ALIGNMENTS = "sample_id string, ord bigint, qname string, flag int, ref_id int, pos bigint, mpos bigint, isize int, l_seq int, nh int, cigar array<struct<op:string,len:int>>"
FRAGMENTS = "sample_id string, ref_id int, start bigint, end bigint, has_junction boolean, gap_start bigint, gap_end bigint"
OWNERS_KEPT = 5  # fixed, as above


@dataclass(frozen=True)
class Options:
    """mode: 1 single-end, 2 paired-end. strandness: 0 none, 1 stranded, 2 reversely stranded.

    exact_end and ref_consuming_only switch two habits of stored coordinates off: the end one past a read's last base, and
    junction offsets that count every CIGAR operation. strict raises when no fragment has a junction."""

    mode: int = 2
    strandness: int = 0
    max_gap: int = 500_000
    multi: bool = False
    primary: bool = False
    pairing: str = "adjacent"
    gene_max_gap: int = 500_000
    exact_end: bool = False
    ref_consuming_only: bool = False
    strict: bool = False

    def __post_init__(self):
        if self.mode not in (1, 2) or self.strandness not in (0, 1, 2) or self.pairing not in ("adjacent", "keyed"):
            raise ValueError("mode is 1 or 2, strandness 0, 1 or 2, pairing adjacent or keyed")
