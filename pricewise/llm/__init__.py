"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage; ``__spark_entry__.py`` adds
its queries only if it can be imported. One module per operator:

near_dedup     1  chosen-path set similarity join, connected groups
chat           2  event-sourced chat reconstruction and rendering (native)
quality        3  co-trained quality classifier
toxicity       4  compression-distance toxicity classifier
piece_codec    5  merge-agenda encoding and decoding with a piece vocabulary
mixing_lm      6  online logistic context mixing
token_counts   7  greedy word-piece lengths by a failure-link automaton
fingerprints   8  bottom-k sketches
source_mix     9  time-varying curriculum over sources
topk          10  block-max WAND search
packing       11  best-fit packing by large-item matching
alignment     12  alignment of two tokenizers by common byte ends
manifest      13  Merkle manifest by butterfly exchange
"""
