"""Command line: batch, fetch, turntable, pixelart, inspect, check."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys

from lumidisc.functions.text import NOMINAL_BYTES
from lumidisc.sinks.files import find_root


def byte_size(text: str) -> int:
    import re

    from lumidisc.functions.text import _UNITS

    m = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?|\.[0-9]+)([a-z]*)", re.sub("[ _]", "", text).lower())
    if not m or m[2] not in _UNITS:
        raise argparse.ArgumentTypeError(f"not a size: {text}")
    return int(float(m[1]) * _UNITS[m[2]])


def human(n: int) -> str:
    return next((f"{n / size:.1f} {unit}" for unit, size in (("GiB", 1 << 30), ("MiB", 1 << 20), ("KiB", 1 << 10)) if n >= size), f"{n} B")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lumidisc", description=__doc__)
    home = find_root(os.curdir)  # outputs and mirrors lie at the repository's top, wherever in it the command is given
    top.add_argument("--master", default="local[*]")
    sub = top.add_subparsers(dest="command", required=True)
    b = sub.add_parser("batch", help="cut bright discs out of a folder of images")
    b.add_argument("source")
    b.add_argument("-o", "--output", default=os.path.join(home, "outputs"))
    b.add_argument("-r", "--recursive", action="store_true")
    b.add_argument("-t", "--threshold", type=int)
    b.add_argument("--blur", type=float, default=1.0)
    b.add_argument("--edge-adjust", type=int, default=0)
    b.add_argument("--pad", type=int, default=0)
    b.add_argument("--min-area", type=float, default=0.001)
    for flag in ("no-fill-holes", "all-blobs", "no-overlays", "force", "dry-run"):
        b.add_argument(f"--{flag}", action="store_true")
    f = sub.add_parser("fetch", help="mirror an archive")
    f.add_argument("base")
    f.add_argument("--collection", choices=("natural", "enhanced", "aerosol", "cloud"), default="natural")
    f.add_argument("--format", choices=sorted(NOMINAL_BYTES), default="png")
    f.add_argument("--root", default=os.path.join(home, "mirror"))
    f.add_argument("--from", dest="start", type=dt.date.fromisoformat)
    f.add_argument("--to", dest="end", type=dt.date.fromisoformat)
    f.add_argument("--spread", type=int)
    f.add_argument("--date", action="append", type=dt.date.fromisoformat)
    f.add_argument("--last", type=int)
    f.add_argument("--max-bytes", type=byte_size, default="10GiB")
    f.add_argument("--delay", type=float, default=0.5)
    f.add_argument("--retries", type=int, default=5)
    f.add_argument("--user-agent", default="lumidisc")
    for flag in ("no-probe", "revalidate", "force", "dry-run"):
        f.add_argument(f"--{flag}", action="store_true")
    t = sub.add_parser("turntable", help="a turning globe from a mirror")
    t.add_argument("mirror")
    t.add_argument("-o", "--output", default=os.path.join(home, "outputs"))
    for name, kind, default in (("lat0", float, 0.0), ("frames", int, 72), ("radius", int, 800), ("min-cos", float, 0.35), ("luminance-floor", float, 30), ("obliqueness-penalty", float, 0.5), ("blend-k", int, 1), ("blend-margin", float, 1.5), ("max-candidates", int, 48), ("reference-scale", float, 4), ("scorer", str, "rgb"), ("collection", str, "natural"), ("fmt", str, "png")):
        t.add_argument(f"--{name}", type=kind, default=default)
    t.add_argument("--no-gif", action="store_true")
    t.add_argument("--no-contact-sheet", action="store_true")
    p = sub.add_parser("pixelart", help="small sprites from rotation frames")
    p.add_argument("source")
    p.add_argument("-o", "--output", default=os.path.join(home, "outputs"))
    p.add_argument("--sizes", default="32,64,128")
    for name, kind, default in (("stylize", float, 1.0), ("saturation-boost", float, 1.8), ("gamma", float, 2.4), ("contrast", float, 0.35), ("black-point", float, 0.05), ("land-green", float, 1.0), ("colors", int, 32), ("downsample", str, "nearest"), ("supersample", int, 1), ("display-scale", int, None)):
        p.add_argument(f"--{name}", type=kind, default=default)
    for flag in ("dither", "no-shared-palette", "no-gif", "no-sheet"):
        p.add_argument(f"--{flag}", action="store_true")
    c = sub.add_parser("check", help="report on one image")
    c.add_argument("image")
    i = sub.add_parser("inspect", help="do files of another collection show discs beside the natural frames?")
    i.add_argument("mirror")
    i.add_argument("-o", "--output", help="a PNG with the sampled pairs")
    i.add_argument("--other", default="cloud")
    return top


def selected(days: list[dt.date], a: argparse.Namespace) -> list[tuple[dt.date, dt.date]]:
    """(requested, resolved): explicit dates, else the last ones, else a spread, else a range, else the newest day."""
    from lumidisc.operators.dates import spread

    if a.date:
        return sorted(((d, min(days, key=lambda x: (abs((x - d).days), x))) for d in a.date), key=lambda pair: pair[1]) if days else []
    if a.last:
        return [(d, d) for d in days[-a.last :]]
    start, end = a.start or (days[0] if days else dt.date.min), a.end or (days[-1] if days else dt.date.max)
    if a.spread:
        return spread(days, start, end, a.spread)
    if a.start or a.end:
        return [(d, d) for d in days if start <= d <= end]
    return [(d, d) for d in days[-1:]]


def run_fetch(a: argparse.Namespace, client=None) -> int:
    from lumidisc.plans import mirror
    from lumidisc.sources.http import ArchiveError, Client

    client = client or Client(a.base, delay=a.delay, retries=a.retries, agent=a.user_agent)
    try:
        picked = selected(mirror.available_dates(client, a.collection, a.root, write=not a.dry_run), a)
        if not picked:
            print("no day matches", file=sys.stderr)
            return 1
        plan = mirror.build_plan(client, a.root, a.collection, a.format, [d for _, d in picked], probe=not a.no_probe, write=not a.dry_run, force=a.force)
        for asked, day in picked:
            mine, gone = ([image for d, image in x if d == day] for x in (plan.present + plan.missing, plan.missing))
            need = sum(plan.sizes.get(i, NOMINAL_BYTES[a.format]) for i in gone)
            print(f"{day}: {len(mine)} frames, {plan.swept[day]:.0f} degrees swept, {len(gone)} missing, {human(need)}" + (f" (asked for {asked}, {abs((day - asked).days)} days off)" if day != asked else ""))
        share = f", {100 * (plan.mirror_bytes + plan.download_bytes) / a.max_bytes:.0f} % of what is allowed" if a.max_bytes else ""
        print(f"mirror {human(plan.mirror_bytes)}, to come {human(plan.download_bytes)}{share}")
        if a.dry_run or not (plan.missing or a.revalidate):
            return 0
        s = mirror.fetch(client, plan, a.root, max_bytes=a.max_bytes, revalidate=a.revalidate, force=a.force)
    except ArchiveError as e:
        print(e, file=sys.stderr)
        return 2
    print(f"{s.downloaded} downloaded, {s.skipped} skipped, {s.current} current, {s.failed} failed, {human(s.bytes)}")
    for e in s.errors[:10]:
        print(f"  {e}")
    return int(s.failed > 0 or s.stopped)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "fetch":
        return run_fetch(a)
    from lumidisc.session import build

    spark = build(a.master)
    try:
        if a.command == "batch":
            from lumidisc.plans import segment_batch as plan

            settings = plan.Settings(a.threshold, a.blur, a.edge_adjust, not a.no_fill_holes, not a.all_blobs, a.pad, a.min_area)
            run, found = plan.process(spark, a.source, a.output, settings, recursive=a.recursive, overlays=not a.no_overlays, force=a.force, dry_run=a.dry_run)
            counts = found.groupBy("status").count().collect()
            print(run, ", ".join(f"{r['count']} {r['status']}" for r in counts))
            for r in plan.review(found).orderBy("input").limit(10).collect():
                print(f"  {r['input']}: {r['reason']}")
            return int(not counts or any(r["status"] == "failed" for r in counts))
        if a.command == "turntable":
            from lumidisc.plans import turntable as plan

            settings = plan.TurntableSettings(a.lat0, a.frames, a.radius, 1.08, a.min_cos, a.luminance_floor, a.obliqueness_penalty, a.blend_k, a.blend_margin, a.max_candidates, a.reference_scale, a.scorer, a.collection, a.fmt)
            run, report = plan.render_all(spark, a.mirror, a.output, settings, write_gif=not a.no_gif, write_sheet=not a.no_contact_sheet)
            rows = report.collect()
            with open(f"{run}/manifest.json") as f:
                told = json.load(f)
            print(run, f"{len(rows)} frames from {told['candidates']} candidates ({told['segmented']} segmented now), reference coverage {100 * told['reference_coverage']:.1f} %, mean suspect fraction {100 * told['mean_suspect_fraction']:.4f} %, {sum(r['suspect_fraction'] > 0.05 for r in rows)} need a look")
            return 0
        if a.command == "pixelart":
            from lumidisc.plans import sprites as plan

            settings = plan.SpriteSettings(plan.parse_sizes(a.sizes), a.stylize, a.saturation_boost, a.gamma, a.contrast, a.black_point, a.land_green, a.colors, a.dither, a.downsample, a.supersample, a.display_scale, not a.no_shared_palette)
            run, report = plan.render_all(spark, a.source, a.output, settings, write_gif=not a.no_gif, write_sheet=not a.no_sheet)
            print(run)
            report.show()
            return 0
        if a.command == "inspect":
            from lumidisc.plans import inspect_pairs as plan

            rows = plan.inspect(spark, a.mirror, a.output, a.other).orderBy("stamp").collect()
            for r in rows:
                print(f"{r['stamp']}: {r['width']} x {r['height']}, fill ratio {r['fill']:.3f}, aspect ratio {r['aspect']:.3f}, {'a' if r['is_disc'] else 'no'} disc, {r['colors']} colours" if r["height"] > 0 else f"{r['stamp']}: cannot be decoded")
            print(f"{len(rows)} pairs looked at")
            return 0
        from lumidisc.plans.segment_batch import report as describe
        from lumidisc.sources.images import array_of, read_images

        row = read_images(spark, a.image).first().asDict()
        print("cannot be decoded" if row["height"] < 0 else describe(array_of(row)))
        return int(row["height"] < 0)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 1
    except (NotADirectoryError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
