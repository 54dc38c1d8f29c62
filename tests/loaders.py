"""Loaders for tests of models that workers hold."""

import os
import pathlib
import uuid

import numpy as np


class Scaled:
    def __init__(self, factor):
        self.factor = factor

    def __call__(self, x):
        return np.asarray(x, dtype=np.float32) * self.factor


def scaled(path, log=""):
    if log:
        pathlib.Path(log, f"{os.getpid()}-{uuid.uuid4()}").write_text("loaded")
    return Scaled(float(pathlib.Path(path).read_text()))
