"""That the README states the bounds of the code."""

from pathlib import Path

from matchstats.llm import toxicity


def test_readme_states_the_bound_of_the_sample():
    text = (Path(__file__).parent.parent.parent / "README.md").read_text()
    assert "{:,} + {} labelled documents of at most {:,} characters".format(*toxicity.SAMPLE_ROWS, toxicity.SAMPLE_CHARS) in text
