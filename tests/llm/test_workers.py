"""Workers are handed from stage to stage: what one operator keeps in them must not lie beside the next one's work."""

import subprocess
import sys

import public_tokenizers
import pyarrow as pa

from tallycast.llm import neardup, packing, toxicity, workers

TOKENS = packing.Tokens(public_tokenizers.path("word_bpe_49k.json"))


def test_other_work_forgets_what_packing_remembers():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([b"some words of a text", None])], ["doc_id", "text"])
    cut = workers.lean(packing._pieces(TOKENS), TOKENS)
    first = pa.Table.from_batches(cut(iter([batch])))
    words = workers.kept(TOKENS, lambda: None)
    assert words.young and pa.Table.from_batches(cut(iter([batch]))) == first
    assert workers.kept(TOKENS, lambda: None) is words  # kept from task to task
    assert len(list(workers.lean(neardup._read_sets(neardup.Index()))(iter([batch])))) == 1
    assert TOKENS not in workers._kept
    assert pa.Table.from_batches(cut(iter([batch]))) == first


def test_a_broken_off_task_forgets_too():
    workers.kept("a", list)
    part = workers.lean(lambda batches: batches, "b")(iter([1, 2]))
    assert next(part) == 1 and "a" not in workers._kept
    workers.kept("a", list)
    part.close()
    assert "a" not in workers._kept


def test_workers_load_no_machine_learning():
    names = [m.__name__ for m in (neardup, packing, toxicity, workers)]
    subprocess.run([sys.executable, "-c", f"import sys, {', '.join(names)}\nassert not {{'pyspark.ml', 'pandas'}} & set(sys.modules)"], check=True)
