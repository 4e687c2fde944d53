"""Variants and genotypes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of variant types.
REF, SNP, MNP, INDEL, OTHER, BND, OVERLAP = 0, 1, 2, 4, 8, 16, 32


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, F.lit(0)).when(F.size(differs) > 0, F.element_at(differs, 1) - 1).otherwise(n)


def _rests(ref: Column, alt: Column) -> tuple[Column, Column, Column, Column]:
    """(prefix, places of the last letter of what differs in both, whether those letters are equal).

    Common letters go from the left, then from the right as long as both keep one.
    """
    r, a = F.upper(ref), F.upper(alt)
    prefix = common_prefix(r, a)
    left = F.least(F.length(r), F.length(a)) - prefix - 1
    suffix = F.least(common_prefix(F.reverse(r), F.reverse(a)), F.greatest(left, F.lit(0)))
    re, ae = F.length(r) - prefix - 1 - suffix, F.length(a) - prefix - 1 - suffix
    return prefix, re, ae, F.substring(r, prefix + re + 1, F.lit(1)) == F.substring(a, prefix + ae + 1, F.lit(1))


def _no_variant(alt: Column) -> Column:
    return alt.isin("<X>", "<*>", "<NON_REF>")


def variant_type(ref: Column, alt: Column) -> Column:
    """Type code of one alternative allele against the reference, in any case of letters."""
    single = (F.length(ref) == 1) & (F.length(alt) == 1)
    prefix, re, ae, equal = _rests(ref, alt)
    return (
        F.when(alt == "*", F.lit(OVERLAP))
        .when(single, F.when((alt == ref) | alt.isin(".", "X"), F.lit(REF)).otherwise(F.lit(SNP)))
        .when(alt.startswith("<"), F.when(_no_variant(alt), F.lit(REF)).otherwise(F.lit(OTHER)))
        .when((prefix == F.length(ref)) & (prefix == F.length(alt)), F.lit(REF))
        .when((prefix == F.length(ref)) & F.substring(alt, prefix + 1, F.lit(1)).isin("[", "]"), F.lit(BND))
        .when((prefix == F.length(ref)) | (prefix == F.length(alt)), F.lit(INDEL))
        .when((re == 0) & (ae == 0), F.lit(SNP))
        .when((re == 0) | (ae == 0), F.when(equal, F.lit(INDEL)).otherwise(F.lit(OTHER)))
        .otherwise(F.when(re == ae, F.lit(MNP)).otherwise(F.lit(OTHER)))
    )


def variant_length(ref: Column, alt: Column) -> Column:
    """Letters that one alternative allele adds, takes away (below 0) or changes; null for symbolic ones and breakends."""
    kind = variant_type(ref, alt)
    prefix, re, ae, _ = _rests(ref, alt)
    return (
        F.when(kind.isin(REF, OVERLAP), F.lit(0))
        .when(kind == SNP, F.lit(1))
        .when((kind == BND) | alt.startswith("<"), F.lit(None))
        .when((prefix == F.length(ref)) | (prefix == F.length(alt)), F.length(alt) - F.length(ref))
        .when(ae == 0, -re)
        .when(re == 0, ae)
        .when(re > ae, -(re + 1))
        .otherwise(ae + 1)
    )


def record_types(ref: Column, alts: Column) -> Column:
    """The types of all alternatives, or-ed."""
    return F.aggregate(F.transform(alts, lambda a: variant_type(ref, a)), F.lit(0), lambda x, t: x.bitwiseOR(t))


def is_snp(ref: Column, alts: Column) -> Column:
    return (F.length(ref) == 1) & F.forall(alts, lambda a: (F.length(a) == 1) | a.isin("<X>", "<*>"))


def alleles(gt: Column) -> Column:
    """Allele numbers of a genotype text such as ``0/1`` or ``1|.``; null is missing."""
    return F.transform(F.split(gt, r"[/|]"), lambda x: F.when(x != ".", x.cast("int")))


def genotype_class(gt: Column) -> Column:
    """HOM_RR, HOM_AA, HET_RA, HET_AA, HAPL_R, HAPL_A or UNKN where an allele is missing."""
    a = alleles(gt)
    zero = F.exists(a, lambda x: x == 0)
    same = F.forall(a, lambda x: x == F.element_at(a, 1))
    return (
        F.when(F.exists(a, lambda x: x.isNull()), "UNKN")
        .when(F.size(a) == 1, F.when(zero, "HAPL_R").otherwise("HAPL_A"))
        .when(same, F.when(zero, "HOM_RR").otherwise("HOM_AA"))
        .otherwise(F.when(zero, "HET_RA").otherwise("HET_AA"))
    )


def trim_alleles(alts: Column, gts: Column) -> Column:
    """Alternatives that some genotype (array of texts) has, in their order."""
    used = F.array_distinct(F.flatten(F.transform(gts, alleles)))
    return F.filter(F.transform(F.sequence(F.lit(1), F.size(alts)), lambda i: F.when(F.array_contains(F.filter(used, lambda x: x.isNotNull()), i), F.element_at(alts, i))), lambda x: x.isNotNull())
