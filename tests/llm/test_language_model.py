"""A model is held without an object per word: every worker has one."""

import gc

import numpy as np

from cytoweave.llm.language import Model, Places, Predictor


def test_places_of_strings():
    names = ["", "a", "été", "中文", "zz", "word"]
    places = Places(names)
    assert places.find([*reversed(names), "ab", "été "]) == [5, 4, 3, 2, 1, 0, -1, -1]
    assert Places([]).find(["a"]) == [-1] and places.find([]) == []


def test_a_string_with_the_hash_of_another_is_not_found(monkeypatch):
    places = Places(["a", "b"])
    monkeypatch.setattr(places, "_hashes", lambda names: places.hashes[:1].repeat(len(names)))
    assert sorted(places.find(["a", "b", "c"])) == sorted([-1, -1, int(places.row[0])])


def test_a_model_holds_few_objects_and_scores_as_counted():
    counts = {0: {f"w{i}": np.array([i % 3, 1], dtype=np.float32) for i in range(5000)}, 1: {"w": np.array([1, 9], dtype=np.float32)}}
    before = len(gc.get_objects())
    model = Model(["a", "b"], counts, 1)
    assert not any(isinstance(held, dict) for table in model.tables for held in table)
    assert len(gc.get_objects()) - before < 1000
    logs = np.log((np.array([2, 1]) + 0.5) / (np.array([sum(i % 3 for i in range(5000)), 5000]) + 2500))
    assert np.allclose(model.score_words(["w5"])[0], logs) and np.allclose(model.score_words(["wx"])[0], np.log([1.5 / 1.5, 9.5 / 9.5]))
    assert Predictor(model).predict("w5 w5")[0] == ("a" if logs[0] > logs[1] else "b")
