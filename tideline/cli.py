"""python -m tideline register: create a namespace of a store."""

from __future__ import annotations

import argparse

from tideline.plans.store import PointStore
from tideline.session import local_session


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tideline")
    parser.add_argument("--root", required=True, help="folder of the store")
    parser.add_argument("--origin", required=True, help="the namespace")
    parser.add_argument("--threshold", type=int, default=None, help="bytes of an object beyond which an epoch ends")
    commands = parser.add_subparsers(dest="command", required=True)
    register = commands.add_parser("register", help="create the namespace")
    register.add_argument("--simple-buckets", type=int, required=True)
    register.add_argument("--extended-buckets", type=int, required=True)
    given = parser.parse_args(args)
    with PointStore(local_session(cores=1, memory="1g"), given.root) as store:
        try:
            new = store.register(given.origin, given.simple_buckets, given.extended_buckets, given.threshold)
        except ValueError as e:
            parser.error(str(e))
    print("Registered" if new else "Already registered")
    return 0
