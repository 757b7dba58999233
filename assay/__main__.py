from assay.cli import main

raise SystemExit(main())
