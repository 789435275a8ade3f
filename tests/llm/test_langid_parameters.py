import inspect

from vellum.llm import langid


def test_sample_and_passes_are_those_that_were_measured():
    assert inspect.signature(langid.fit).parameters["sample"].default == 6000
    assert inspect.signature(langid.ftrl).parameters["epochs"].default == 4
