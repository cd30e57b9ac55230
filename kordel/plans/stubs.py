"""A stand-in for a model, for tests and the inference query."""

from __future__ import annotations


def echo_model(family: str, prompts: list[str]) -> list[str]:
    """Answers every prompt of more than 20 characters by a program and every other by an unfinished one."""
    return [f'. memory.store :text="{family}"</s>' if len(p) > 20 else ". memory.store :text=" for p in prompts]
