"""Operators for training-data pipelines; nothing else in the library imports them."""

from pyspark import cloudpickle

from storelens.llm import (
    ann,
    archives,
    common,
    conversations,
    decontamination,
    license_templates,
    licenses,
    mixing,
    quality_fm,
    queries,
    resampling,
    samples,
    sharding,
    simhash,
    substring_dedup,
    token_counts,
    toxicity,
)

for _module in (
    ann, archives, common, conversations, decontamination, license_templates, licenses, mixing, quality_fm,
    queries, resampling, samples, sharding, simhash, substring_dedup, token_counts, toxicity,
):
    # functions that run in workers travel with the job, so executors need no copy of this package
    cloudpickle.register_pickle_by_value(_module)
