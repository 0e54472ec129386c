"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, language, packing, run_length_index, simhash, sketch, suffix_automaton, tiff, token_files


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        chat.op1_perspective_rotation,
        tiff.op2_tiff_pages,
        simhash.op3_multi_index,
        suffix_automaton.op4_suffix_automata,
        sketch.op5_bottom_k,
        run_length_index.op6_run_length_bwt,
        bpe.op7_rank_array_bpe,
        packing.op8_best_two_fit,
        language.op9_hyperdimensional,
        token_files.op10_seekable_zstd,
        pipeline,
    )
}

SQL = {"op1_perspective_rotation": chat.SQL, "op4_suffix_automata": suffix_automaton.SQL, "op6_run_length_bwt": run_length_index.SQL}
