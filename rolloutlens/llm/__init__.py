"""Training-data operators: language ID, line dedup, main-text extraction,
document fingerprints, BPE, SimHash near-dedup, toxicity, license scans,
exact top-k search over binary codes, sequence packing.

Nothing else in the library imports this subpackage. Every operator takes a
DataFrame and the names of the columns it reads, selects only those columns,
and returns columns of its own, so extra or clashing columns of the input
never reach its plan.
"""
