"""python -m isogrid interpolate|compress|decompress INPUT OUTPUT [--config FILE]"""

from __future__ import annotations

import argparse

from .config import CompressionConfig, InterpolationConfig
from .plans.files import OUTPUTS, compress_files, decompress_files, interpolate_files
from .session import session


def main(args: list[str] | None = None) -> list[str]:
    p = argparse.ArgumentParser(prog="isogrid", description="Point files to grids; rasters to an archive of compressed blocks, and back.")
    p.add_argument("job", choices=("interpolate", "compress", "decompress"))
    p.add_argument("input", help="a file, a folder or a pattern; for decompress, the archive")
    p.add_argument("output", help="a folder; for compress, the archive")
    p.add_argument("--config", help="settings as JSON")
    p.add_argument("--outputs", nargs="+", choices=OUTPUTS, default=["tif"], help="of interpolate")
    a = p.parse_args(args)
    spark = session()
    if a.job == "interpolate":
        done = interpolate_files(spark, a.input, InterpolationConfig.load(a.config) if a.config else InterpolationConfig(), a.output, tuple(a.outputs))
    elif a.job == "compress":
        done = compress_files(spark, a.input, CompressionConfig.load(a.config) if a.config else CompressionConfig(), a.output)
    else:
        done = decompress_files(spark, a.input, a.output)
    print("\n".join(done))
    return done


if __name__ == "__main__":
    main()
